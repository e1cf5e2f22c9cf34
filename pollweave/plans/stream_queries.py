"""Registered queries: the polling jobs, run once over the whole events table.

Each has a batch twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.functions import normalize
from pollweave.operators import overlay
from pollweave.plans.history_queries import DELTA_RATE
from pollweave.plans.join_queries import LAST_KNOWN_GOOD
from pollweave.plans.scalar_queries import TIME_BUCKET
from pollweave.session import run_folder
from pollweave.streaming import jobs


# Polls arrive in so many micro-batches.
BATCHES = 4


def _events(spark, sf):
    """The events as polls that land in several files, taken up batch by batch.

    Files are ranges of event ids and arrive in no order of time, so some rows are late.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    parts = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    landed = run_folder(spark, "landed-events")
    events.repartitionByRange(parts, "event_id").write.parquet(landed)
    per_batch = -(-parts // BATCHES)
    return jobs.read_polls(spark, landed, events.schema, files_per_trigger=per_batch)


def stream_bucket(spark, sf):
    folder = run_folder(spark, "stream-bucket")
    jobs.finish(jobs.start_buckets(_events(spark, sf), folder, "ts"))
    return jobs.read_buckets(spark, folder).select(
        normalize.iso_seconds(F.unix_seconds("bucket")).alias("bucket"), "records"
    )


def stream_dedupe(spark, sf):
    folder = run_folder(spark, "stream-dedupe")
    events = _events(spark, sf)
    twice = jobs.union_polls(events, events)
    jobs.finish(jobs.start_dedupe(twice, folder, ["event_id"]))
    return jobs.read_dedupe(spark, folder, twice.schema).select(
        "event_id", "user_id", "event_type", "value")


STREAM_DEDUPE = "SELECT event_id, user_id, event_type, value FROM events"


def stream_last_known(spark, sf):
    folder = run_folder(spark, "stream-last-known")
    events = _events(spark, sf)
    jobs.finish(
        jobs.start_last_known(events, folder, ["user_id"], ["ts", "event_id"], "value", 50)
    )
    schema = "user_id bigint, value double, last_good double"
    latest = jobs.read_last_known(spark, folder, schema, ["user_id"])
    return latest.select(
        "user_id",
        "value",
        overlay.best_maximum(F.col("value"), F.col("last_good"), F.lit(0.0), 50).alias("max_health"),
    )


def stream_delta_rate(spark, sf):
    folder = run_folder(spark, "stream-delta-rate")
    events = _events(spark, sf)
    jobs.finish(
        jobs.start_delta_rate(events, folder, ["user_id"], "ts", "value", ["event_id"])
    )
    columns = ["user_id", "ts", "event_id", "value"]
    return jobs.read_delta_rate(spark, folder, events, columns).select(
        "event_id", "user_id", "rate"
    )


QUERIES = {
    "stream_bucket": (stream_bucket, TIME_BUCKET),
    "stream_dedupe": (stream_dedupe, STREAM_DEDUPE),
    "stream_last_known": (stream_last_known, LAST_KNOWN_GOOD),
    "stream_delta_rate": (stream_delta_rate, DELTA_RATE),
}
