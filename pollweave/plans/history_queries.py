"""Registered queries: latest rows, retention, carry-forward and change over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.functions import fixed
from pollweave.operators import history
from pollweave.plans.sql import rounded
from pollweave.session import run_folder
from pollweave.sources import state
from pollweave.sources.tables import table


def _events(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")


def priority_dedupe(spark, sf):
    events = _events(spark, sf)
    event_kind = F.when(F.col("event_type") == "purchase", 1)
    return history.priority_dedupe(
        events, "user_id", F.col("event_type").isin("purchase", "error"), event_kind,
        F.col("event_id"),
    ).select("user_id", "event_id", "event_type", "value")


PRIORITY_DEDUPE = """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, event_id) = 1
"""


def carry_forward(spark, sf):
    events = _events(spark, sf).select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"),
    )
    filled = history.carry_forward(events, ["user_id"], ["ts", "event_id"], ["value"])
    return filled.select("event_id", "user_id", "value")


CARRY_FORWARD = """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM events
"""


def delta_rate(spark, sf):
    rows = _events(spark, sf).select("event_id", "ts", "user_id", "value")
    rated = history.delta_rate(rows, ["user_id"], "ts", "value", ["event_id"])
    return rated.select("event_id", "user_id", "rate")


DELTA_RATE = f"""
WITH p AS (
  SELECT *, value - lag(value) OVER w AS dv, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000 AS h
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN abs(dv) > 0.01 AND h > 0 THEN {rounded('dv / h', 3)} END AS rate FROM p
"""


def latest_record(spark, sf):
    latest = history.last_per_key(
        _events(spark, sf), ["event_type"], [F.col("ts"), F.col("event_id")]
    )
    return latest.select("event_type", "event_id", "user_id", "value")


LATEST_RECORD = """
SELECT event_type, event_id, user_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1
"""


def topk_latest(spark, sf):
    documents = table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    newest = history.newest(documents, [F.desc("doc_id")], fixed.BULLETINS_KEPT)
    news = history.newest(documents, [F.desc("doc_id")], fixed.NEWS_KEPT)
    return newest.withColumn("list", F.lit("bulletins")).unionByName(
        news.withColumn("list", F.lit("news"))
    )


TOPK_LATEST = """
(SELECT doc_id, lang, source, n_chars, 'bulletins' AS list FROM documents ORDER BY doc_id DESC LIMIT 30)
UNION ALL
(SELECT doc_id, lang, source, n_chars, 'news' FROM documents ORDER BY doc_id DESC LIMIT 5)
"""


def retention_tail(spark, sf):
    events = _events(spark, sf).select("event_id", "ts", "user_id", "value")
    newest_first = [F.desc("ts"), F.desc("event_id")]
    series = history.retention_tail(events, newest_first).withColumn("scope", F.lit("series"))
    users = history.newest_per_key(events, ["user_id"], newest_first, 5).withColumn(
        "scope", F.lit("user")
    )
    return series.unionByName(users).drop("ts")


RETENTION_TAIL = """
(SELECT event_id, user_id, value, 'series' AS scope FROM events
 ORDER BY ts DESC, event_id DESC LIMIT 288)
UNION ALL
SELECT event_id, user_id, value, 'user' FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn <= 5
"""


def append_if_absent(spark, sf):
    events = _events(spark, sf).select("event_id", "user_id", "event_type", "value")
    store = events.where(F.col("event_type") != "purchase").withColumn("origin", F.lit("store"))
    incoming = events.withColumn("origin", F.lit("incoming"))
    # Every record arrives twice; the store knows most of them.
    twice = incoming.unionByName(incoming)
    return history.append_if_absent(store, twice, ["event_id"])


APPEND_IF_ABSENT = """
SELECT event_id, user_id, event_type, value,
  CASE event_type WHEN 'purchase' THEN 'incoming' ELSE 'store' END AS origin FROM events
"""

def keyed_upsert(spark, sf):
    """Three runs upsert the newest good value of each user into one cache."""
    events = _events(spark, sf).where(F.col("value") >= 50)
    folder, cache = run_folder(spark, "value-cache"), None
    for run in range(3):
        fresh = history.last_per_key(
            events.where(F.col("event_id") % 3 == run).select("user_id", "value", "ts", "event_id"),
            ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "value")
        cache = state.update_cache(spark, folder, fresh, ["user_id"], run)
    return cache


KEYED_UPSERT = """
SELECT user_id, arg_max(value, {'run': event_id % 3, 'ts': ts, 'id': event_id}) AS value
FROM events WHERE value >= 50 GROUP BY user_id
"""

QUERIES = {
    "keyed_upsert": (keyed_upsert, KEYED_UPSERT),
    "priority_dedupe": (priority_dedupe, PRIORITY_DEDUPE),
    "carry_forward": (carry_forward, CARRY_FORWARD),
    "delta_rate": (delta_rate, DELTA_RATE),
    "latest_record": (latest_record, LATEST_RECORD),
    "topk_latest": (topk_latest, TOPK_LATEST),
    "retention_tail": (retention_tail, RETENTION_TAIL),
    "append_if_absent": (append_if_absent, APPEND_IF_ABSENT),
}
