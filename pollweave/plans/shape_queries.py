"""Registered queries: nested documents to rows and back, owned columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.operators import shaping
from pollweave.sources.tables import table

_DOCUMENT = "doc_id bigint, meta struct<lang: string, source: string>, lines array<string>"


def distinct_collect(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id", "event_type")
    kinds = shaping.distinct_in_order(events, ["user_id"], "event_type", F.col("event_id"))
    return kinds.select("user_id", F.concat_ws(",", "event_types").alias("event_types"))


DISTINCT_COLLECT = """
SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS event_types FROM (
  SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)
GROUP BY user_id
"""


def nested_explode(spark, sf):
    documents = table(spark, sf, "documents", "doc_id", "lang", "source", "text")
    nested = documents.select(
        F.to_json(
            F.struct(
                "doc_id",
                F.struct("lang", "source").alias("meta"),
                F.split("text", "\n").alias("lines"),
            )
        ).alias("body")
    )
    parsed = nested.select(F.from_json("body", _DOCUMENT).alias("doc")).select("doc.*")
    rows = parsed.withColumn("first_line", shaping.first_item(F.col("lines")))
    return shaping.explode_items(
        rows.withColumn("lang", F.col("meta.lang")), F.col("lines"), "doc_id", "lang", "first_line"
    ).withColumnRenamed("item", "line")


NESTED_EXPLODE = """
WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, lang, lines[1] AS first_line, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS line
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)
"""


def map_explode(spark, sf):
    events = table(spark, sf, "events", "event_id", "props")
    return shaping.explode_map(events, F.from_json("props", "map<string, bigint>"), "event_id")


MAP_EXPLODE = """
SELECT event_id, k AS entry_key, CAST(props ->> k AS BIGINT) AS entry_value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
"""


def document_assemble(spark, sf):
    customers = table(spark, sf, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    segments = customers.groupBy(
        "c_nationkey", F.col("c_mktsegment").alias("segment")
    ).agg(F.count(F.lit(1)).alias("customers"), F.sum(cents).alias("cents"))
    lists = shaping.nested_lists(segments, ["c_nationkey"], "segments", ["segment"])
    nations = table(spark, sf, "nation", "n_nationkey", "n_name")
    rows = nations.join(lists, nations.n_nationkey == lists.c_nationkey, "left").select(
        "n_nationkey",
        F.col("n_name").alias("nation"),
        F.coalesce("segments", F.from_json(F.lit("[]"), lists.schema["segments"].dataType)).alias(
            "segments"
        ),
    )
    return shaping.as_document(rows, ["n_nationkey"])


DOCUMENT_ASSEMBLE = """
WITH s AS (
  SELECT c_nationkey, c_mktsegment, count(*) AS n,
    CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM customer GROUP BY ALL)
SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"nation":"' || n_name || '","segments":[' ||
  coalesce(string_agg('{"segment":"' || c_mktsegment || '","customers":' || n || ',"cents":' || cents
    || '}', ',' ORDER BY c_mktsegment), '') || ']}' AS document
FROM nation LEFT JOIN s ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
"""


def column_owned_merge(spark, sf):
    fresh = table(spark, sf, "documents", "doc_id", "lang", "n_chars")
    previous = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    return shaping.keep_owned(fresh, previous, ["doc_id"], {"quality": -1, "toxic": -1})


COLUMN_OWNED_MERGE = """
SELECT doc_id, lang, n_chars, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)
"""

QUERIES = {
    "distinct_collect": (distinct_collect, DISTINCT_COLLECT),
    "nested_explode": (nested_explode, NESTED_EXPLODE),
    "map_explode": (map_explode, MAP_EXPLODE),
    "document_assemble": (document_assemble, DOCUMENT_ASSEMBLE),
    "column_owned_merge": (column_owned_merge, COLUMN_OWNED_MERGE),
}
