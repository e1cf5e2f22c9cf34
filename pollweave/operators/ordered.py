"""Row-to-row operators along the poll order of each key.

Rows are range-partitioned on (key, order), which cuts large keys into even segments; each
segment is handled by itself, and only the last row of each segment is carried to the next
one of its key. So no key goes to one task, whatever its size, and nothing is counted first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pollweave.session import written

SEGMENT = "_segment"


def previous_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
) -> DataFrame:
    """Add ``prev_<column>``: the value of the row before, within the key."""

    rows = _segmented(df, keys, order)
    within = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    tails = rows.groupBy(*keys, SEGMENT).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    tails = tails.withColumn("_before", F.lag("_tail").over(across)).drop("_tail")
    inner = rows.select(
        "*",
        F.row_number().over(within).alias("_rn"),
        *[F.lag(c).over(within).alias(f"prev_{c}") for c in columns],
    )
    joined = _join_segments(inner, tails, keys)
    first = F.col("_rn") == 1
    return joined.select(
        *rows.columns,
        *[
            F.when(first, F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}")
            for c in columns
        ],
    ).drop(SEGMENT)


def last_known(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
) -> DataFrame:
    """Add ``last_<column>``: the newest non-null value up to and including the row."""

    rows = _segmented(df, keys, order)
    within = (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.struct(*order)
    tails = rows.groupBy(*keys, SEGMENT).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_tail_{c}")
            for c in columns
        ]
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = tails.select(
        *keys,
        SEGMENT,
        *[
            F.last(f"_tail_{c}", ignorenulls=True).over(across).alias(f"_before_{c}")
            for c in columns
        ],
    )
    inner = rows.select(
        "*", *[F.last(c, ignorenulls=True).over(within).alias(f"last_{c}") for c in columns]
    )
    return (
        _join_segments(inner, tails, keys)
        .select(
            *rows.columns,
            *[
                F.coalesce(F.col(f"last_{c}"), F.col(f"_before_{c}")).alias(f"last_{c}")
                for c in columns
            ],
        )
        .drop(SEGMENT)
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, column: str
) -> DataFrame:
    """Add the row's number within the key, from 0, and ``prev_<column>``: the row before.

    Rows that agree in all of ``order`` and ``column`` must be equal.
    """
    rows = _segmented(df, keys, order)
    within = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    tails = rows.groupBy(*keys, SEGMENT).agg(
        F.max_by(column, F.struct(*order)).alias("_tail"), F.count(F.lit(1)).alias("_rows"))
    across = Window.partitionBy(*keys).orderBy(SEGMENT)
    tails = tails.select(
        *keys, SEGMENT,
        F.lag("_tail").over(across).alias("_before"),
        F.coalesce(
            F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_earlier"),
    )
    inner = rows.select(
        "*", F.row_number().over(within).alias("_rn"), F.lag(column).over(within).alias("_prev"))
    joined = _join_segments(inner, tails, keys)
    return joined.select(
        *df.columns,
        (F.col("_earlier") + F.col("_rn") - 1).alias(name),
        F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_prev")).alias(
            f"prev_{column}"),
    )


def _segmented(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with their segment's number, written: both passes must read the same one.

    They are written as columns, so that the pass over the segments' ends reads only these.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn(SEGMENT, F.spark_partition_id())
    return written(ranged, "segments")


def _join_segments(rows: DataFrame, tails: DataFrame, keys: list[str]) -> DataFrame:
    renamed = tails.select(
        *[F.col(k).alias(f"_t_{k}") for k in [*keys, SEGMENT]],
        *[c for c in tails.columns if c not in (*keys, SEGMENT)],
    )
    condition = _null_safe(rows, renamed, [*keys, SEGMENT], "_t_")
    return rows.join(renamed, condition, "left")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys]
    )
