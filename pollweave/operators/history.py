"""Latest rows, bounded history, de-duplication and change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pollweave.functions import fixed, metrics
from pollweave.operators import ordered


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, so each task keeps one row per key before anything is shuffled.
    ``order`` has to be total; nulls come first.
    """
    others = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order`` (see ``first_per_key``)."""
    others = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def priority_dedupe(
    df: DataFrame, key: str, defense: Column, event_kind: Column, sequence: Column
) -> DataFrame:
    """One contest per entity: event-typed, then other defences, then the first seen.

    Rows without an entity are left out.
    """
    rank = F.when(event_kind.isNotNull(), 0).when(defense, 1).otherwise(2)
    return first_per_key(df.where(F.col(key).isNotNull()), [key], [rank, sequence])


def newest(df: DataFrame, order: list[Column], k: int = fixed.BULLETINS_KEPT) -> DataFrame:
    """The first ``k`` rows in ``order`` over the whole table."""
    return df.orderBy(*order).limit(k)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; every task cuts to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def retention_tail(
    df: DataFrame, order: list[Column], k: int = fixed.HISTORY_RECORDS
) -> DataFrame:
    """The last ``k`` records of a single series."""
    return newest(df, order, k)


def append_if_absent(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The store plus the incoming rows whose key it does not hold yet.

    Repeats inside the incoming rows are dropped too, see ``new_rows``.
    """
    return store.unionByName(new_rows(store, incoming, keys))


def new_rows(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the store does not hold.

    Of different rows with the same key the smallest counts, so that a repeated task
    picks the same one.
    """
    known = store.select(*keys).distinct()
    fresh = incoming.join(known, keys, "left_anti")
    others = [F.col(c) for c in incoming.columns if c not in keys]
    return first_per_key(fresh, keys, others) if others else fresh.distinct()


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
) -> DataFrame:
    """Replace null values by the newest earlier non-null value of the key."""
    filled = ordered.last_known(df, keys, order, columns)
    return filled.select(
        *[F.col(f"last_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def delta_rate(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    tie: list[str] | None = None,
) -> DataFrame:
    """Add ``rate``: change of ``value`` per hour since the key's previous poll."""
    before = ordered.previous_values(df, keys, [ts, *(tie or [])], [ts, value])
    return before.withColumn("rate", rate_since(ts, value)).drop(f"prev_{ts}", f"prev_{value}")


def rate_since(ts: str, value: str) -> Column:
    """The rate between a row and its ``prev_`` columns; ``ts`` is a timestamp."""
    micros = F.unix_micros(ts) - F.unix_micros(f"prev_{ts}")
    return metrics.delta_per_hour(F.col(value), F.col(f"prev_{value}"), micros / 3_600_000_000)


def latest_and_good(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    floor: float = fixed.ABSOLUTE_MAX_FLOOR,
) -> DataFrame:
    """Per key the newest value, and as ``last_good`` the newest that reached ``floor``.

    One aggregate, the same for a batch and for a stream.
    """
    position = F.struct(*order)
    good = F.col(value) >= floor
    return df.groupBy(*keys).agg(
        F.max_by(value, position).alias(value),
        F.max_by(F.col(value), F.when(good, position)).alias("last_good"),
    )
