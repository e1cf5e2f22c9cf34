"""Shared steps: session settings, staged tables, filters ahead of joins, Arrow streams."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pollweave.session import prepare, run_folder

# Rows per Arrow batch: documents may be long, so a batch is bounded by few of them.
BATCH_ROWS = 400
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """The session with this library's settings, short Arrow batches, and its own code.

    Tasks import this package, so it is sent along once per application.
    """
    prepare(spark)
    _ship(spark)
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def _ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(context._temp_dir, f"{package.name}.zip")  # goes when the session ends
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    folder = run_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


# Bits of the filter that goes ahead of a join: 256 kB, whatever the input.
FILTER_BITS = 1 << 21


def likely(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A filter for rows whose key may be among ``keys``: it lets all of these through.

    One bit per hash of a key; the driver holds FILTER_BITS of them. Far beyond that many
    keys more and more other rows pass, which costs a shuffle and changes no result.
    """
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FILTER_BITS))
    words = keys.groupBy(F.shiftright(at, 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias(
            "bits")).collect()
    table = [0] * (FILTER_BITS // 32)
    for row in words:
        table[row.word] = row.bits
    bits = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def passes(column: Column) -> Column:
        own = F.pmod(F.xxhash64(column.cast("string")), F.lit(FILTER_BITS))
        word = F.get(bits, F.shiftright(own, 5).cast("int"))
        return F.getbit(word, (own % 32).cast("int")) == 1

    return passes


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores, so that no column has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def settled(df: DataFrame, row: str, result: Column, name: str) -> DataFrame:
    """The fields of the struct ``row`` with ``result``, worked out once per row.

    The one-element explode keeps later filters on the result above it: pushed through a
    chain of projections, a filter would repeat all their expressions inside one another.
    """
    return df.select(row, F.explode(F.array(result)).alias(name)).select(f"{row}.*", name)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str
) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns."""
    arrow = pa_schema(schema)

    def run(batches):
        for columns in function(batches):
            if columns is not None:
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                        for c, f in ((columns[f.name], f) for f in arrow)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def pa_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))
