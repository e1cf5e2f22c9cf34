"""Rounding of the exact binary value to a number of decimals.

``round`` works on the shortest decimal form of a double, so 2.675, which is a
little less than that, becomes 2.68. Here it becomes 2.67, and an exact tie such
as 0.125 goes to the even neighbour (or up).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Below this many units all steps are exact; larger values keep the plain rounding.
_LARGEST = 1e15


def half_even(value: Column, digits: int) -> Column:
    """To ``digits`` decimals; exact ties to the even neighbour."""
    # Only a tie is small enough for the nudge to decide.
    return _rounded(value, digits, lambda low: (F.pmod(low, F.lit(2.0)) - 0.5) * 1e-300)


def half_up(value: Column, digits: int) -> Column:
    """To ``digits`` decimals; exact ties up."""
    return _rounded(value, digits, lambda low: F.lit(1e-300))


def _rounded(value: Column, digits: int, nudge) -> Column:
    # Kept short: ``value`` stands in for an expression that is repeated in the plan.
    value = value.cast("double")
    finer = float(10 ** (digits + 1))
    nearest = F.rint(value * finer)
    # Only a double that is the closest one to some ...5 can be decided wrongly.
    doubtful = (
        (nearest / finer == value)
        & (F.pmod(nearest, F.lit(10.0)) == 5)
        & (F.abs(value) < _LARGEST / finer)
    )
    # Both halves of the value times ``finer`` are exact, and so is the gap.
    high = value.cast("float").cast("double")
    gap = (high * finer - nearest) + (value - high) * finer
    low = F.floor(nearest / 10).cast("double")
    up = F.when(gap + nudge(low) > 0, 1.0).otherwise(0.0)
    decided = (low + up) / float(10**digits)
    return F.when(doubtful, decided).otherwise(F.round(value, digits))
