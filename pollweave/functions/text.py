"""Display text of an entity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pollweave.functions import falsy, fixed, normalize
from pollweave.functions.rounding import half_up


def owner_colour(label: Column) -> Column:
    """Colour of the faction that holds an entity."""
    return normalize.lookup(label, fixed.OWNER_COLOURS, fixed.OWNER_COLOUR_DEFAULT)


def contest_colour(label: Column) -> Column:
    """Colour of a contest's faction, under either spelling."""
    return normalize.lookup(label, fixed.CONTEST_COLOURS, fixed.CONTEST_COLOUR_DEFAULT)


def race_colour(code: Column) -> Column:
    """Colour of a faction code; null outside the table."""
    return normalize.lookup(code.cast("int"), fixed.RACE_CODE_COLOURS)


def sector_colour(local_name: Column) -> Column:
    """Colour of a sector by its local name."""
    return normalize.lookup(local_name, fixed.SECTOR_COLOURS, fixed.SECTOR_COLOUR_DEFAULT)


def local_owner(label: Column) -> Column:
    """Local name of a faction; other labels stay."""
    return normalize.lookup(label, fixed.OWNER_LOCAL, label)


def weapon_class(code: Column) -> Column:
    """Local name of a weapon class; null outside the table."""
    return normalize.lookup(code, fixed.WEAPON_CLASSES)


def percent_text(current: Column, maximum: Column) -> Column:
    """Health in percent with two decimals, or the mark for a missing maximum."""
    share = F.try_divide(current, falsy.number(maximum)).cast("double") * 100
    shown = half_up(share, 2).cast("decimal(38,2)").cast("string")
    return F.coalesce(shown, F.lit(fixed.SUMMARY_HEALTH_MISSING))


def summary(
    name: Column,
    owner: Column,
    state: Column,
    sector: Column,
    current: Column,
    maximum: Column,
    players: Column,
) -> Column:
    """Lines about one entity; the state line is left out where there is no contest."""
    state_text = F.when(state == fixed.DEFENSE, fixed.SUMMARY_STATE_DEFENSE).otherwise(
        fixed.SUMMARY_STATE_OTHER
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.SUMMARY_NAME), name),
        F.concat(F.lit(fixed.SUMMARY_OWNER), local_owner(normalize.canonical_faction(owner))),
        F.when(
            falsy.text(state).isNotNull(), F.concat(F.lit(fixed.SUMMARY_STATE), state_text)
        ),
        F.concat(F.lit(fixed.SUMMARY_SECTOR), sector),
        F.concat(
            F.lit(fixed.SUMMARY_HEALTH),
            percent_text(current, maximum),
            F.lit(fixed.SUMMARY_HEALTH_UNIT),
        ),
        F.concat(
            F.lit(fixed.SUMMARY_PLAYERS),
            F.coalesce(players, F.lit(0)).cast("bigint").cast("string"),
        ),
    )
