"""Places and running sums over rows in one order, cut into even ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pollweave.llm.common import staged


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows of a written table sorted by ``order``, written again with their place.

    The column ``place`` rises in that order; its upper bits (from the 34th on) are the range
    partition. Nulls come first. Equal rows are told apart by where they stood, so they are
    spread over the ranges like others.
    """
    keys = [*order, "__stood"]
    cut = df.withColumn("__stood", F.monotonically_increasing_id()).repartitionByRange(*keys)
    return staged(
        cut.sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("__stood"),
        name,
    )


def range_of(place: str) -> Column:
    """The range partition of a place."""
    return F.shiftright(place, 33)


def running(
    rows: DataFrame, group: list[str], value: Column, name: str, facts: DataFrame | None = None
) -> DataFrame:
    """``rows`` (of ``ranged``) with the sum of ``value`` over the group's earlier rows.

    A group of any size is summed range by range; one number for each group and range meets
    the numbers of its other ranges. ``facts`` has one row per group, with the columns
    ``group``; its other columns are added too, and travel with that number: rows meet both
    by group and range, so no group goes to one task.
    """
    cut = rows.withColumn("__range", range_of("place")).withColumn("__value", value)
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "__range").agg(F.sum("__value").alias("__sum"))
    firsts = sums.select(
        *[F.col(g).alias(f"__of_{g}") for g in group],
        F.col("__range").alias("__of_range"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__first"),
    )
    told = []
    if facts is not None:
        told = [c for c in facts.columns if c not in group]
        firsts = firsts.join(facts, _same(group, "__of_", ""), "left").drop(*group)
    within = Window.partitionBy(*group, "__range").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    own = cut.withColumn("__own", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    same = (F.col("__range") == F.col("__of_range")) & _same(group, "", "__of_")
    return own.join(firsts, same).select(
        *rows.columns, (F.col("__first") + F.col("__own")).cast("long").alias(name), *told)


def _same(group: list[str], left: str, right: str) -> Column:
    found = F.lit(True)
    for g in group:
        found = found & F.col(f"{left}{g}").eqNullSafe(F.col(f"{right}{g}"))
    return found


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each group of a written table, in order.

    Ranges follow the rows, so a group of any size, and equal rows, are spread over tasks.
    """
    places = ranged(df, [*group, *order], name)
    return running(places, group, F.lit(1), name).drop("place")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches as tables that hold whole groups of ``keys`` (never null)."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        last = None
        for key in keys:
            same = pc.equal(rows[key], rows[key][rows.num_rows - 1])
            last = same if last is None else pc.and_(last, same)
        begin = rows.num_rows - pc.sum(last).as_py()
        if begin:
            yield rows.slice(0, begin)
        held = rows.slice(begin)
    if held is not None:
        yield held


def starts(rows: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of a sorted table begin, and its length."""
    found = [0]
    columns = [rows[key].to_pylist() for key in keys]
    marks = list(zip(*columns, strict=True))
    for at in range(1, len(marks)):
        if marks[at] != marks[at - 1]:
            found.append(at)
    return [*found, len(marks)]
