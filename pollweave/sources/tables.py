"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan one table, only the given columns; zone-less times become UTC timestamps."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    names = columns or df.columns
    return df.select(
        *[
            F.col(c).cast("timestamp").alias(c)
            if df.schema[c].dataType.typeName() == "timestamp_ntz"
            else F.col(c)
            for c in names
        ]
    )
