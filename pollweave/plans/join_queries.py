"""Registered queries: assembly, enrichment, overlays, precedence and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.functions import falsy, fixed, metrics, normalize
from pollweave.operators import history, network, overlay, precedence, shaping
from pollweave.plans.sql import case, rounded
from pollweave.sources import health
from pollweave.sources.tables import table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def full_outer_assemble(spark, sf):
    info = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        F.col("doc_id").alias("entity_id"), "quality", "toxic"
    )
    status = table(spark, sf, "embeddings", "vec_id", "label").select(
        F.col("vec_id").alias("entity_id"), "label"
    )
    entities = overlay.assemble(info, status, ["entity_id"], {"quality": 0, "toxic": 0})
    return entities.select(
        "entity_id",
        "quality",
        "toxic",
        falsy.first_number(F.col("label"), F.lit(1)).alias("max_health"),
        normalize.synthetic_name(F.col("entity_id")).alias("name"),
    ).orderBy("entity_id")


FULL_OUTER_ASSEMBLE = """
SELECT coalesce(l.doc_id, e.vec_id) AS entity_id, coalesce(quality, 0) AS quality,
  coalesce(toxic, 0) AS toxic, coalesce(nullif(label, 0), 1) AS max_health,
  'PLANET_' || coalesce(l.doc_id, e.vec_id) AS name
FROM labels l FULL OUTER JOIN embeddings e ON l.doc_id = e.vec_id
"""


def contest_enrich(spark, sf):
    contests = table(
        spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    ).withColumnRenamed("o_custkey", "c_custkey")
    info = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    first = history.first_per_key(info, ["c_custkey"], [F.col("c_name")])
    nations = table(spark, sf, "nation", "n_nationkey", "n_name").select(
        F.col("n_nationkey").alias("i_c_nationkey"), "n_name"
    )
    event_max = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    enriched = overlay.attach(contests, first, ["c_custkey"], "i_")
    return enriched.join(nations, "i_c_nationkey", "left").select(
        "o_orderkey",
        F.coalesce(
            falsy.text(F.col("i_c_name")), normalize.synthetic_name(F.col("c_custkey"))
        ).alias("name"),
        F.coalesce("n_name", F.lit("")).alias("sector"),
        normalize.decode_code(
            F.col("i_c_nationkey").cast("string"), fixed.OWNER_CODES, fixed.UNKNOWN
        ).alias("faction"),
        falsy.first_number(event_max, F.col("i_c_acctbal"), F.lit(0.0)).alias("max_health"),
    )


CONTEST_ENRICH = f"""
SELECT o_orderkey, coalesce(nullif(c_name, ''), 'PLANET_' || o_custkey) AS name,
  coalesce(n_name, '') AS sector,
  {case("c_nationkey", fixed.OWNER_CODES, "'Unknown'")} AS faction,
  coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END, 0),
    nullif(c_acctbal, 0), 0) AS max_health
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
"""


def overlay_conditional(spark, sf):
    base = table(spark, sf, "documents", "doc_id", "n_chars").select(
        "doc_id", F.col("n_chars").alias("quality"), F.lit(7).cast("bigint").alias("toxic")
    )
    labels = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    source = labels.select("doc_id", "quality", "toxic", F.col("toxic").alias("regen"))
    settled = overlay.overlay(
        base,
        source,
        ["doc_id"],
        {
            "quality": overlay.take_number,
            "toxic": overlay.take_number,
            "regen": overlay.take_or_zero,
        },
    )
    return settled.withColumn("regen", F.col("regen").cast("bigint"))


OVERLAY_CONDITIONAL = """
SELECT doc_id, coalesce(nullif(quality, 0), n_chars) AS quality,
  CAST(coalesce(nullif(toxic, 0), 7) AS BIGINT) AS toxic, CAST(toxic AS BIGINT) AS regen
FROM documents LEFT JOIN labels USING (doc_id)
"""


def overlay_precedence(spark, sf):
    key = F.col("s_suppkey")
    named = F.when(key % 2 == 1, normalize.synthetic_name(key)).otherwise(F.col("s_name"))
    base = table(spark, sf, "supplier").select(
        key.alias("entity_id"),
        named.alias("name"),
        F.lit("").alias("sector"),
        F.col("s_acctbal").alias("max_health"),
    )
    source = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
        F.col("c_acctbal").alias("max_health"),
    )
    settled = overlay.overlay(
        base,
        source,
        ["entity_id"],
        {
            "name": overlay.take_if_stand_in,
            "sector": overlay.take_always,
            "max_health": overlay.take_below(),
        },
    )
    # The same overlay on a contest's embedded record.
    embedded = settled.withColumn("planet", F.struct("name", "sector")).withColumn(
        "planet", F.col("planet").withField("sector", F.upper("sector"))
    )
    return embedded.select(
        "entity_id", "name", "sector", "max_health", F.col("planet.sector").alias("planet_sector")
    )


OVERLAY_PRECEDENCE = """
SELECT s_suppkey AS entity_id,
  CASE WHEN s_suppkey % 2 = 1 THEN coalesce(c_name, 'PLANET_' || s_suppkey) ELSE s_name END AS name,
  coalesce(c_mktsegment, '') AS sector,
  CASE WHEN c_custkey IS NOT NULL AND (s_acctbal = 0 OR s_acctbal < 1000)
    THEN coalesce(nullif(c_acctbal, 0), s_acctbal) ELSE s_acctbal END AS max_health,
  upper(coalesce(c_mktsegment, '')) AS planet_sector
FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey
"""


def last_known_good(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "value")
    latest = history.latest_and_good(events, ["user_id"], ["ts", "event_id"], "value", 50)
    return latest.select(
        "user_id",
        "value",
        overlay.best_maximum(F.col("value"), F.col("last_good"), F.lit(0.0), 50).alias("max_health"),
    )


LAST_KNOWN_GOOD = """
SELECT user_id, max_by(value, event_id) AS value,
  CASE WHEN max_by(value, event_id) >= 50 THEN max_by(value, event_id)
    ELSE coalesce(max_by(value, event_id) FILTER (value >= 50), 0) END AS max_health
FROM (SELECT user_id, value, row_number() OVER (ORDER BY ts, event_id) AS event_id FROM events)
GROUP BY user_id
"""


def sum_with_fallback(spark, sf):
    lines = (
        table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    )
    orders = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return overlay.attach(orders, lines, ["o_orderkey"], "l_").select(
        "o_orderkey",
        overlay.sum_or(
            F.col("l_total"), F.col("l__matched").isNotNull(), F.col("o_totalprice")
        ).alias("players"),
    )


SUM_WITH_FALLBACK = """
SELECT o_orderkey, coalesce(total, o_totalprice, 0) AS players
FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
"""


def case_insensitive_join(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    written = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.initcap("p_name"))
    by_name = network.first_by_name(
        parts.select(written.alias("p_name"), F.col("p_partkey").alias("first_id")),
        "p_name",
        F.col("first_id"),
    ).select("name_key", "first_id")
    return network.join_by_name(parts, "p_name", by_name).select("p_partkey", "first_id")


CASE_INSENSITIVE_JOIN = """
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY upper(p_name)) AS first_id FROM part
"""


def exists_flag(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "entity_id")
    contests = table(
        spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"
    ).where(F.col("o_orderstatus") == "P")
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    found = contests.select(
        F.col("o_custkey").alias("entity_id"), "o_orderkey", kind.alias("contest_type")
    )
    return network.with_exists(
        customers,
        found,
        ["entity_id"],
        [F.col("o_orderkey")],
        {"contest_type": fixed.LIBERATION},
        "is_contested",
    )


EXISTS_FLAG = """
SELECT c_custkey AS entity_id, kind IS NOT NULL AS is_contested, kind AS contest_type
FROM customer LEFT JOIN (
  SELECT o_custkey, min_by(CASE WHEN o_orderpriority = '5-LOW' THEN 'liberation'
    ELSE o_orderpriority END, o_orderkey) AS kind
  FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey
"""


def anti_fill(spark, sf):
    keyed = table(spark, sf, "labels", "doc_id", "quality")
    nested = table(spark, sf, "documents", "doc_id", "lang", "source")
    return network.anti_fill(keyed, nested, "doc_id", F.col("source"))


ANTI_FILL = """
SELECT doc_id, quality, NULL AS lang, NULL AS source, 'keyed' AS origin FROM labels
UNION ALL
SELECT doc_id, NULL, lang, source, 'filled' FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


def keyed_union(spark, sf):
    plain = table(spark, sf, "orders", "o_custkey", "o_orderstatus").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("type")
    )
    events = table(spark, sf, "events", "user_id", "event_type", "value").select(
        F.col("user_id").alias("entity_id"), F.lit("defense").alias("type"), "event_type", "value"
    )
    both = shaping.keyed_union(plain, events)
    return both.groupBy("type").agg(
        F.count(F.lit(1)).alias("contests"),
        F.count("event_type").alias("with_event"),
        F.sum("entity_id").alias("id_sum"),
    )


KEYED_UNION = """
SELECT type, count(*) AS contests, count(event_type) AS with_event,
  CAST(sum(entity_id) AS BIGINT) AS id_sum
FROM (SELECT o_custkey AS entity_id, o_orderstatus AS type, NULL AS event_type FROM orders
  UNION ALL SELECT user_id, 'defense', event_type FROM events)
GROUP BY type
"""


def _daily(spark, sf, name, ts, value):
    return table(spark, sf, name, ts, value).select(
        F.to_date(ts).alias("poll"), F.col(value).cast("double").alias("value")
    )


def source_precedence(spark, sf):
    stacked = precedence.stack(
        {
            "primary": _daily(spark, sf, "events", "ts", "value"),
            "aggregate": _daily(spark, sf, "orders", "o_orderdate", "o_totalprice"),
            "rest": _daily(spark, sf, "lineitem", "l_shipdate", "l_extendedprice"),
        }
    )
    # One row per poll and source first, so the choice is one more small aggregate.
    totals = stacked.groupBy("poll", "source", "source_rank").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
    )
    return precedence.whole_record(totals, ["poll"]).withColumn(
        "poll", F.col("poll").cast("string")
    )


SOURCE_PRECEDENCE = """
WITH stacked AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS poll, value, 0 AS rank, 'primary' AS source FROM events
  UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_totalprice, 1, 'aggregate' FROM orders
  UNION ALL SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_extendedprice, 2, 'rest' FROM lineitem)
SELECT poll, source, count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM stacked JOIN (SELECT poll, min(rank) AS rank FROM stacked GROUP BY poll) USING (poll, rank)
GROUP BY poll, source
"""


def poll_rows(spark, sf):
    def entities(name, ts, key):
        return table(spark, sf, name, ts, key).select(
            F.to_date(ts).alias("poll"), F.col(key).alias("entity_id")
        )

    stacked = precedence.stack(
        {
            "primary": entities("events", "ts", "user_id"),
            "aggregate": entities("orders", "o_orderdate", "o_custkey"),
            "rest": entities("lineitem", "l_shipdate", "l_suppkey"),
        }
    )
    seen = stacked.groupBy("poll", "entity_id", "source", "source_rank").agg(
        F.count(F.lit(1)).alias("records")
    )
    chosen = precedence.whole_poll(seen, ["poll"]).drop("source_rank")
    return chosen.withColumn("poll", F.col("poll").cast("string"))


POLL_ROWS = """
WITH stacked AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS poll, user_id AS entity_id, 0 AS rank, 'primary' AS source
  FROM events
  UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_custkey, 1, 'aggregate' FROM orders
  UNION ALL SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), l_suppkey, 2, 'rest' FROM lineitem)
SELECT poll, entity_id, source, count(*) AS records
FROM stacked JOIN (SELECT poll, min(rank) AS rank FROM stacked GROUP BY poll) USING (poll, rank)
GROUP BY ALL
"""


def _entity_sources(spark, sf):
    labels = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        F.col("doc_id").alias("entity_id"),
        F.col("quality").cast("bigint").alias("score"),
        F.col("toxic").cast("bigint").alias("size"),
    )
    documents = table(spark, sf, "documents", "doc_id", "lang", "n_chars").select(
        F.col("doc_id").alias("entity_id"), F.col("lang").alias("title"),
        F.col("n_chars").alias("size"),
    )
    vectors = table(spark, sf, "embeddings", "vec_id", "label").select(
        F.col("vec_id").alias("entity_id"),
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("title"),
        F.col("label").cast("bigint").alias("score"),
        F.col("label").cast("bigint").alias("size"),
    )
    return {"primary": labels, "aggregate": documents, "rest": vectors}


def record_precedence(spark, sf):
    stacked = precedence.stack(_entity_sources(spark, sf))
    return precedence.whole_record(stacked, ["entity_id"])


RECORD_PRECEDENCE = """
WITH s AS (
  SELECT doc_id AS entity_id, NULL AS title, CAST(quality AS BIGINT) AS score,
    CAST(toxic AS BIGINT) AS size, 'primary' AS source, 0 AS rank FROM labels
  UNION ALL SELECT doc_id, lang, NULL, n_chars, 'aggregate', 1 FROM documents
  UNION ALL SELECT vec_id, 'v' || label, label, label, 'rest', 2 FROM embeddings)
SELECT entity_id, title, score, size, source FROM s
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rank) = 1
"""


def field_precedence(spark, sf):
    stacked = precedence.stack(_entity_sources(spark, sf))
    return precedence.by_field(
        stacked,
        ["entity_id"],
        {
            "title": ["aggregate", "primary", "rest"],
            "score": ["primary", "aggregate", "rest"],
            "size": ["rest", "aggregate", "primary"],
        },
        {
            "title": falsy.text(F.col("title")),
            "score": falsy.number(F.col("score")),
            "size": falsy.number(F.col("size")),
        },
    )


FIELD_PRECEDENCE = """
SELECT entity_id,
  coalesce(nullif(d.lang, ''), 'v' || e.label) AS title,
  CASE WHEN nullif(d.lang, '') IS NOT NULL THEN 'aggregate'
    WHEN e.label IS NOT NULL THEN 'rest' END AS title_source,
  CAST(coalesce(nullif(l.quality, 0), nullif(e.label, 0)) AS BIGINT) AS score,
  CASE WHEN nullif(l.quality, 0) IS NOT NULL THEN 'primary'
    WHEN nullif(e.label, 0) IS NOT NULL THEN 'rest' END AS score_source,
  CAST(coalesce(nullif(e.label, 0), nullif(d.n_chars, 0), nullif(l.toxic, 0)) AS BIGINT) AS size,
  CASE WHEN nullif(e.label, 0) IS NOT NULL THEN 'rest'
    WHEN nullif(d.n_chars, 0) IS NOT NULL THEN 'aggregate'
    WHEN nullif(l.toxic, 0) IS NOT NULL THEN 'primary' END AS size_source
FROM (SELECT doc_id AS entity_id FROM documents UNION SELECT doc_id FROM labels
  UNION SELECT vec_id FROM embeddings)
LEFT JOIN labels l ON l.doc_id = entity_id LEFT JOIN documents d ON d.doc_id = entity_id
LEFT JOIN embeddings e ON e.vec_id = entity_id
"""


def source_health(spark, sf):
    tables = {name: table(spark, sf, name) for name in TABLES}
    events = tables["events"]
    tables["silent"] = events.where(F.col("value") < 0)
    absent, found = health.optional(
        spark, events.schema, lambda: table(spark, sf, "no_such_source")
    )
    return health.report(tables).unionByName(health.status_row("absent", absent, found))


SOURCE_HEALTH = "\nUNION ALL ".join(
    [f"SELECT '{name}' AS source, count(*) > 0 AS ok, count(*) AS rows FROM {name}" for name in TABLES]
    + ["SELECT 'silent', count(*) > 0, count(*) FROM events WHERE value < 0", "SELECT 'absent', false, 0"]
)


def counts_summary(spark, sf):
    def counted(name, key):
        return table(spark, sf, name, key).agg(F.count(F.lit(1)).alias("n")).scalar()

    orders = table(spark, sf, "orders", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("contests"),
        F.count_if(F.col("o_orderstatus") == "P").alias("active"),
    )
    return orders.select(
        "contests",
        "active",
        counted("customer", "c_custkey").alias("entities"),
        counted("documents", "doc_id").alias("bulletins"),
        counted("events", "event_id").alias("records"),
    )


COUNTS_SUMMARY = """
SELECT count(*) AS contests, count(*) FILTER (o_orderstatus = 'P') AS active,
  (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM documents) AS bulletins,
  (SELECT count(*) FROM events) AS records
FROM orders
"""


def entity_board(spark, sf):
    """The flagship: assemble two sources, overlay two more, measure; every entity stays."""
    info = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal").select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("owner_code"),
        F.col("c_acctbal").alias("max_health"),
    )
    price = F.col("o_totalprice").cast("decimal(18,2)")
    status = (
        table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
        .groupBy(F.col("o_custkey").alias("entity_id"))
        .agg(
            F.count(F.lit(1)).alias("contests"),
            F.sum(F.when(F.col("o_orderstatus") == "O", price)).cast("double").alias("health"),
            F.sum(price).cast("double").alias("total"),
        )
    )
    activity = (
        table(spark, sf, "events", "user_id", "value")
        .groupBy(F.col("user_id").alias("entity_id"))
        .agg(F.count(F.lit(1)).alias("players"))
    )
    base = overlay.assemble(
        info, status, ["entity_id"], {"contests": 0, "health": 0.0, "total": 0.0}
    ).withColumn("players", F.lit(0).cast("bigint"))
    seen = overlay.overlay(base, activity, ["entity_id"], {"players": overlay.take_number})
    maximum = overlay.best_maximum(F.col("total"), F.col("max_health"), F.col("health"))
    return seen.select(
        "entity_id",
        falsy.first_text(F.col("name"), normalize.synthetic_name(F.col("entity_id"))).alias("name"),
        normalize.decode_code(F.col("owner_code"), fixed.OWNER_CODES, fixed.UNKNOWN).alias("owner"),
        "contests",
        "players",
        metrics.defender_progress(F.col("health"), maximum).alias("progress"),
    )


ENTITY_BOARD = f"""
WITH status AS (
  SELECT o_custkey AS id, count(*) AS contests,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS health,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders GROUP BY 1
), base AS (
  SELECT coalesce(c_custkey, s.id) AS entity_id,
    coalesce(c_name, 'PLANET_' || s.id) AS name,
    {case("c_nationkey", fixed.OWNER_CODES, "'Unknown'")} AS owner,
    coalesce(contests, 0) AS contests, coalesce(health, 0) AS health,
    coalesce(total, 0) AS total, c_acctbal
  FROM customer FULL OUTER JOIN status s ON c_custkey = s.id
), maxed AS (
  SELECT *, CASE WHEN total >= 1000 THEN total WHEN c_acctbal >= 1000 THEN c_acctbal
    ELSE health END AS m FROM base
)
SELECT entity_id, name, owner, contests, coalesce(players, 0) AS players,
  CASE WHEN m <> 0 THEN {rounded('greatest(0, least(1, (m - health) / m)) * 100', 2)} END AS progress
FROM maxed LEFT JOIN (SELECT user_id, count(*) AS players FROM events GROUP BY 1)
  ON user_id = entity_id
"""

QUERIES = {
    "entity_board": (entity_board, ENTITY_BOARD),
    "full_outer_assemble": (full_outer_assemble, FULL_OUTER_ASSEMBLE),
    "contest_enrich": (contest_enrich, CONTEST_ENRICH),
    "overlay_conditional": (overlay_conditional, OVERLAY_CONDITIONAL),
    "overlay_precedence": (overlay_precedence, OVERLAY_PRECEDENCE),
    "last_known_good": (last_known_good, LAST_KNOWN_GOOD),
    "sum_with_fallback": (sum_with_fallback, SUM_WITH_FALLBACK),
    "case_insensitive_join": (case_insensitive_join, CASE_INSENSITIVE_JOIN),
    "exists_flag": (exists_flag, EXISTS_FLAG),
    "anti_fill": (anti_fill, ANTI_FILL),
    "keyed_union": (keyed_union, KEYED_UNION),
    "source_precedence": (source_precedence, SOURCE_PRECEDENCE),
    "poll_rows": (poll_rows, POLL_ROWS),
    "record_precedence": (record_precedence, RECORD_PRECEDENCE),
    "field_precedence": (field_precedence, FIELD_PRECEDENCE),
    "source_health": (source_health, SOURCE_HEALTH),
    "counts_summary": (counts_summary, COUNTS_SUMMARY),
}
