"""The polling jobs as Structured Streaming.

Every job reads a growing folder of polls, runs on a trigger (the refresh interval,
or once over what is there) and can be restarted from its checkpoint. Outputs are
written per micro-batch under the batch's number, so a batch that is repeated after
a failure replaces what it wrote before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pollweave.functions import fixed, normalize
from pollweave.operators import history
from pollweave.sources import state
from pollweave.streaming import keyed

def read_polls(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the parquet files that land under ``path``; zone-less times become UTC."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    polls = reader.parquet(path)
    return polls.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if f.dataType.typeName() == "timestamp_ntz"
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def trigger(refresh: str | None) -> dict:
    """Every ``refresh``, or once over everything available."""
    return {"processingTime": refresh} if refresh else {"availableNow": True}


def start(df: DataFrame, folder: str, mode: str, each_batch=None, refresh: str | None = None):
    """Start a job; without ``each_batch`` rows are appended to ``folder/out``."""
    writer = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger(refresh))
    )
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", f"{folder}/out").start()


def _write_batches(folder: str):
    return lambda rows, batch_id: state.save(rows, f"{folder}/out", batch_id)


def count_buckets(polls: DataFrame, ts: str, width: str = fixed.REFRESH) -> DataFrame:
    """Records per refresh interval; the same expression in batch and stream."""
    return polls.groupBy(normalize.time_bucket(F.col(ts), width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("records")
    )


def start_buckets(polls: DataFrame, folder: str, ts: str, refresh: str | None = None):
    """Count records per interval; each batch appends what it adds to each interval.

    No state is kept: a late record, however old, is one more addition to its interval, and
    the sum of the additions is the count.
    """

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        state.save_change(count_buckets(rows, ts), folder, batch_id, _added_up)

    return start(polls, folder, "append", each_batch, refresh)


def _added_up(additions: DataFrame) -> DataFrame:
    return additions.groupBy("bucket").agg(F.sum("records").alias("records"))


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return state.load_changed(spark, folder, "bucket timestamp, records bigint", _added_up)


def start_dedupe(
    polls: DataFrame, folder: str, keys: list[str], refresh: str | None = None
):
    """Add the records whose key did not come before, however long ago.

    The keys are the stream's state, in RocksDB without a watermark: a batch looks its own
    keys up, and no stored record is read again. Of several records of a key in one batch one
    counts.
    """
    return start(
        polls.dropDuplicates(keys), folder, "append", _write_batches(folder), refresh)


def read_dedupe(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return state.load_all(spark, f"{folder}/out", schema).drop(state.VERSION)


def start_last_known(
    polls: DataFrame,
    folder: str,
    keys: list[str],
    order: list[str],
    value: str,
    floor: float = fixed.ABSOLUTE_MAX_FLOOR,
    refresh: str | None = None,
):
    """Keep the last known good value per key; each batch writes the keys it changed."""
    latest = history.latest_and_good(polls, keys, order, value, floor)

    def each_batch(rows: DataFrame, batch_id: int) -> None:
        state.save_change(rows, folder, batch_id, _newest(keys))

    return start(latest, folder, "update", each_batch, refresh)


def _newest(keys: list[str]):
    return lambda rows: history.last_per_key(rows, keys, [F.col(state.VERSION)]).drop(state.VERSION)


def read_last_known(
    spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str]
) -> DataFrame:
    return state.load_changed(spark, folder, schema, _newest(keys))


def start_delta_rate(
    polls: DataFrame,
    folder: str,
    keys: list[str],
    ts: str,
    value: str,
    tie: list[str],
    refresh: str | None = None,
):
    """Rate of change between successive polls of a key, also where polls arrive late.

    The key's state finds the row before each row of a batch, and the stored row that a late
    row comes in front of; these are rated and written. The newest version of a row counts.
    """
    neighbours = keyed.previous_rows(polls, keys, [ts, *tie], value)
    rated = neighbours.withColumn("rate", history.rate_since(ts, value)).drop(
        f"prev_{ts}", f"prev_{value}")
    return start(rated, folder, "append", _write_batches(folder), refresh)


def _rated(spark, folder, schema, row_keys) -> DataFrame:
    """The newest version of every stored row."""
    stored = state.load_all(
        spark, f"{folder}/out", T.StructType([*schema.fields, T.StructField("rate", T.DoubleType())]))
    return history.last_per_key(stored, row_keys, [F.col(state.VERSION)]).drop(state.VERSION)


def read_delta_rate(
    spark: SparkSession, folder: str, polls: DataFrame, columns: list[str], value: str = "value"
) -> DataFrame:
    """All rated rows; ``polls`` gives the types of the input columns."""
    schema = T.StructType([polls.schema[c] for c in columns])
    return _rated(spark, folder, schema, [c for c in columns if c != value])


def finish(query) -> None:
    """Wait for a job that runs once over what is available."""
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error


def union_polls(*streams: DataFrame) -> DataFrame:
    """Several landing folders as one stream."""
    return reduce(DataFrame.unionByName, streams)
