"""Joins that complete entity rows: assembly, enrichment and per-column overlays.

The lookup side of every join holds one row per key, so no join fans out. No side
is broadcast by hint: Spark broadcasts a side whose measured size is below its
threshold and otherwise joins by shuffle, where adaptive execution splits a key
that holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.functions import falsy, fixed, normalize

Policy = Callable[[Column, Column, Column], Column]

_MATCH = "_matched"


def assemble(
    left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]
) -> DataFrame:
    """Full outer join of two one-row-per-key sides with defaults for what is missing."""
    joined = left.join(right, keys, "full_outer")
    return joined.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
            for c in joined.columns
        ]
    )


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Left join a one-row-per-key lookup; its columns get ``prefix``."""
    renamed = lookup.select(
        *keys,
        F.lit(True).alias(f"{prefix}{_MATCH}"),
        *[F.col(c).alias(f"{prefix}{c}") for c in lookup.columns if c not in keys],
    )
    return rows.join(renamed, keys, "left")


def overlay(
    base: DataFrame, source: DataFrame, keys: list[str], policies: dict[str, Policy]
) -> DataFrame:
    """Left join ``source`` and settle each column by its policy.

    A policy gets the base value, the source value and the match flag. A column
    the base does not have starts as null.
    """
    joined = attach(base, source.select(*keys, *policies), keys, "_o_")
    matched = F.coalesce(F.col(f"_o_{_MATCH}"), F.lit(False))
    settled = {}
    for column, policy in policies.items():
        own = F.col(column) if column in base.columns else F.lit(None)
        settled[column] = policy(own, F.col(f"_o_{column}"), matched).alias(column)
    kept = [settled.pop(c, F.col(c)) for c in base.columns]
    return joined.select(*kept, *settled.values())


def take_number(own: Column, other: Column, matched: Column) -> Column:
    """The source's number unless it is 0 or missing."""
    return F.coalesce(falsy.number(other), own)


def take_array(own: Column, other: Column, matched: Column) -> Column:
    """The source's array unless it is empty or missing."""
    return F.coalesce(falsy.array(other), own)


def take_always(own: Column, other: Column, matched: Column) -> Column:
    """The source's value wherever the source knows the entity and has the value."""
    return F.coalesce(other, own)


def take_or_zero(own: Column, other: Column, matched: Column) -> Column:
    """The source's number, 0 where a matched source has none."""
    return F.when(matched, F.coalesce(other, F.lit(0))).otherwise(own)


def take_if_stand_in(own: Column, other: Column, matched: Column) -> Column:
    """The source's name only where the base name is missing or synthetic."""
    return F.when(matched & normalize.is_stand_in(own), F.coalesce(other, own)).otherwise(own)


def take_below(floor: float = fixed.ABSOLUTE_MAX_FLOOR) -> Policy:
    """The source's maximum where the base has none or only a relative one."""

    def policy(own: Column, other: Column, matched: Column) -> Column:
        relative = falsy.number(own).isNull() | (own < floor)
        return F.when(matched & relative, falsy.first_number(other, own)).otherwise(own)

    return policy


def best_maximum(
    own: Column, cached: Column, current: Column, floor: float = fixed.ABSOLUTE_MAX_FLOOR
) -> Column:
    """Own maximum, else the cached one, else the current health, else 0."""
    return (
        F.when(own >= floor, own)
        .when(cached >= floor, cached)
        .otherwise(F.coalesce(current, F.lit(0)))
    )


def sum_or(total: Column, present: Column, scalar: Column) -> Column:
    """The summed total where the source is present, else the scalar, else 0."""
    return F.when(present, F.coalesce(total, F.lit(0))).otherwise(F.coalesce(scalar, F.lit(0)))
