"""Falsy coalescing: 0, "" and [] count as absent, just like null.

Plain ``coalesce`` is for values where only null means absent.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(value: Column) -> Column:
    """Null when the number is 0."""
    return F.when(value != 0, value)


def text(value: Column) -> Column:
    """Null when the string is empty."""
    return F.when(value != "", value)


def array(value: Column) -> Column:
    """Null when the array is empty."""
    return F.when(F.size(value) > 0, value)


def first_number(*values: Column) -> Column:
    """First non-zero number; the last one is taken as it is."""
    return F.coalesce(*[number(v) for v in values[:-1]], values[-1])


def first_text(*values: Column) -> Column:
    """First non-empty string; the last one is taken as it is."""
    return F.coalesce(*[text(v) for v in values[:-1]], values[-1])


def first_array(*values: Column) -> Column:
    """First non-empty array; the last one is taken as it is."""
    return F.coalesce(*[array(v) for v in values[:-1]], values[-1])
