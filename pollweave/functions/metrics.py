"""Progress, rates, levels and ratios.

A null input that has no defined result gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pollweave.functions import falsy, fixed
from pollweave.functions.rounding import half_even


def _guard(condition: Column, value: Column) -> Column:
    """The value where it is defined.

    Goes inside the rounding, never around it: generated code computes an operand
    once that is always needed, but repeats it all over a conditional branch.
    """
    return F.when(condition, value)


def regen_percent(regen: Column, maximum: Column) -> Column:
    """Regeneration per second as percent of the maximum per hour; 0 without a maximum."""
    share = F.try_divide(F.coalesce(regen, F.lit(0)) * 3600, falsy.number(maximum)) * 100
    return F.coalesce(half_even(share, 2), F.lit(0.0))


def contest_class(kind: Column) -> Column:
    """Defence or liberation, from the contest's type code as text."""
    return F.when(kind.isin(fixed.DEFENSE_CODES), fixed.DEFENSE).otherwise(fixed.LIBERATION)


def with_recon(kind: Column, event_kind: Column, entity_id: Column, otherwise: Column) -> Column:
    """Reconnaissance when the type is 1 and the entity has no event."""
    recon = (kind == str(fixed.RECON_CODE)) & event_kind.isNull() & entity_id.isNotNull()
    return F.when(recon, fixed.RECON).otherwise(otherwise)


def level(maximum: Column, step: float = fixed.LEVEL_STEP) -> Column:
    """Maximum over step, to the nearest whole level (ties to even)."""
    return F.bround(F.try_divide(falsy.number(maximum), F.lit(step)).cast("double"), 0).cast("int")


def defender_progress(current: Column, maximum: Column) -> Column:
    """Share of the maximum already lost, in percent, kept within 0 and 100."""
    share = F.try_divide(maximum - current, maximum)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share.cast("double")))
    defined = (maximum != 0) & current.isNotNull()
    return half_even(_guard(defined, bounded * 100), 2)


def attacker_rate(start: Column, end: Column) -> Column:
    """Percent per hour that fills the whole span; null unless end > start > 0."""
    defined = (start != 0) & (end != 0) & (end > start)
    return half_even(_guard(defined, F.try_divide(F.lit(100), (end - start) / 3600)), 3)


def attacker_progress(rate: Column, start: Column, now: Column) -> Column:
    """Rate times elapsed hours, at most 100; null before the start.

    ``rate`` is the rounded rate of ``attacker_rate``: its rounding shows in the result.
    """
    started = rate.isNotNull() & (start != 0) & (now != 0)
    reached = F.least(F.lit(100.0), rate * ((now - start) / 3600))
    return half_even(_guard(started & (now > start), reached), 2)


def remaining(end: Column, now: Column) -> Column:
    """Time left, never negative; null when either clock is 0."""
    defined = (now != 0) & (end != 0)
    return _guard(defined, F.greatest(F.lit(0), end - now))


def per_hour(count: Column, hours: Column) -> Column:
    """Count per hour; null without a duration."""
    return half_even(F.try_divide(count, falsy.number(hours)), 2)


def share_percent(part: Column, whole: Column) -> Column:
    """Part of the whole in percent; null for an empty whole."""
    return half_even(F.try_divide(part, falsy.number(whole)) * 100, 4)


def ratio_columns(
    won: Column, lost: Column, seconds: Column, kills: list[Column], deaths: Column
) -> dict[str, Column]:
    """Hourly rates and success shares of one entity's totals."""
    hours = falsy.number(seconds) / 3600
    all_kills = sum((F.coalesce(k, F.lit(0)) for k in kills), F.lit(0))
    return {
        "success_per_hour": per_hour(won, hours),
        "fail_per_hour": per_hour(lost, hours),
        "enemies_per_hour": per_hour(all_kills, hours),
        "deaths_per_hour": per_hour(F.coalesce(deaths, F.lit(0)), hours),
        "success_rate": share_percent(won, won + lost),
        "fail_rate": share_percent(lost, won + lost),
    }


def health_percent(current: Column, maximum: Column) -> Column:
    """Health in percent within 0 and 100; 0 without a maximum."""
    share = F.try_divide(current, falsy.number(maximum)).cast("double") * 100
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))
    return F.when(share.isNotNull(), bounded).otherwise(0.0)


def progress_band(percent: Column) -> Column:
    """Colour band of a percentage; null at 0."""
    return (
        F.when(percent > 50, fixed.BAND_HIGH)
        .when(percent > 25, fixed.BAND_MIDDLE)
        .when(percent > 0, fixed.BAND_LOW)
    )


def delta_per_hour(value: Column, before: Column, hours: Column) -> Column:
    """Change per hour since the previous poll.

    Null for the first poll, for a change of at most the epsilon, and when no time passed.
    """
    moved = F.abs(value - before) > fixed.DELTA_EPSILON
    return half_even(_guard(moved & (hours > 0), F.try_divide(value - before, hours)), 3)
