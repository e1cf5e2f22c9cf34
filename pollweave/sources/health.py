"""What each source delivered: rows, nothing, or no readable document at all."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def optional(spark: SparkSession, schema: T.StructType | str, read) -> tuple[DataFrame, bool]:
    """The scan, or an empty typed table when its path does not exist."""
    try:
        return read(), True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), False


def status_row(label: str, df: DataFrame, found: bool = True) -> DataFrame:
    """One status row: a source that is absent or has no row failed."""
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows")).select(
        F.lit(label).alias("source"), (F.lit(found) & (F.col("rows") > 0)).alias("ok"), "rows"
    )


def report(sources: dict[str, DataFrame]) -> DataFrame:
    """A status row per source."""
    return reduce(DataFrame.unionByName, [status_row(k, v) for k, v in sources.items()])


def require_any(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sources that have rows, in order; an error when there are none."""
    present = {label: df for label, df in sources.items() if not df.isEmpty()}
    if not present:
        raise RuntimeError("every source failed: " + ", ".join(sources))
    return present
