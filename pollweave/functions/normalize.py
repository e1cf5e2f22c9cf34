"""Codes, names and times brought to one form."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from pollweave.functions import falsy, fixed


def lookup(key: Column, table: dict, default: Column | str | None = None) -> Column:
    """Value of ``key`` in a fixed table that travels inside the plan as a literal."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = entries[key]
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def _long_keys(table: dict) -> Column:
    return F.create_map(
        *chain.from_iterable((F.lit(k).cast("bigint"), F.lit(v)) for k, v in table.items())
    )


def decode_code(code: Column, table: dict, unknown: str) -> Column:
    """Label of a code held as text: digits are looked up, other text is a label already."""
    digits = code.rlike("^[0-9]+$")
    return (
        F.when(code.isNull(), F.lit(unknown))
        .when(digits, F.coalesce(_long_keys(table)[code.try_cast("bigint")], F.lit(unknown)))
        .otherwise(code)
    )


def decode_variant(value: Column, table: dict, unknown: str, decode_text: bool = True) -> Column:
    """Label of a polymorphic JSON value.

    Integers are looked up, strings are labels, anything else is ``unknown``.
    With ``decode_text`` a string of digits counts as an integer.
    """
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    label = decode_code(as_text, table, unknown) if decode_text else as_text
    found = _long_keys(table)[F.try_variant_get(value, "$", "bigint")]
    return (
        F.when(kind == "STRING", label)
        .when(kind.isin("BIGINT", "BOOLEAN"), F.coalesce(found, F.lit(unknown)))
        .otherwise(F.lit(unknown))
    )


def variant_text(value: Column) -> Column:
    """A scalar JSON value as text."""
    return F.try_variant_get(value, "$", "string")


def variant_truthy(value: Column) -> Column:
    """Whether a JSON value counts as present: not null, false, 0, "", [] or {}."""
    empty = F.to_json(value).isin("false", "0", "0.0", "-0.0", '""', "[]", "{}", "null")
    return F.coalesce(~empty, F.lit(False))


def canonical_faction(label: Column) -> Column:
    """One spelling per faction."""
    return lookup(label, fixed.FACTION_ALIASES, label)


def iso_seconds(seconds: Column, suffix: str = "Z") -> Column:
    """Epoch seconds as ISO text, independent of the session's zone."""
    seconds = seconds.cast("bigint")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400).cast("bigint"))
    parts = (F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    hour, minute, second = (F.lpad(p.cast("string"), 2, "0") for p in parts)
    return F.concat(
        day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, F.lit(suffix)
    )


def iso_epoch(number: Column) -> Column:
    """Epoch seconds or milliseconds as ISO text, "" when missing."""
    whole = number.cast("bigint")
    seconds = F.when(whole > fixed.MILLIS_ABOVE, F.floor(whole / 1000)).otherwise(whole)
    return F.coalesce(iso_seconds(seconds), F.lit(""))


def iso_variant(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text as ISO text, "" when missing."""
    text = F.when(F.schema_of_variant(value) == "STRING", variant_text(value))
    number = F.when(text.isNull(), F.try_variant_get(value, "$", "bigint"))
    return F.coalesce(text, iso_epoch(number))


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp."""
    return F.unix_seconds(ts)


def local_time(ts: Column) -> Column:
    """A timestamp as ISO text at the fixed local offset."""
    shifted = epoch_seconds(ts) + fixed.LOCAL_OFFSET_HOURS * 3600
    return iso_seconds(shifted, f"+{fixed.LOCAL_OFFSET_HOURS:02d}:00")


def now_local() -> Column:
    """The run's time as ISO text at the fixed local offset."""
    return local_time(F.current_timestamp())


def time_bucket(ts: Column, width: str = fixed.REFRESH) -> Column:
    """Start of the refresh interval that holds ``ts``."""
    return F.window(ts, width)["start"]


def synthetic_name(entity_id: Column) -> Column:
    """Stand-in name of an entity that has none."""
    return F.concat(F.lit(fixed.SYNTHETIC_PREFIX), entity_id.cast("string"))


def is_stand_in(name: Column) -> Column:
    """Whether a name is missing or synthetic."""
    return falsy.text(name).isNull() | name.startswith(fixed.SYNTHETIC_PREFIX)
