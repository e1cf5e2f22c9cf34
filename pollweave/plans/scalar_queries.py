"""Registered queries: normalisation, metrics and display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.functions import falsy, fixed, metrics, normalize, text
from pollweave.operators import overlay, precedence, shaping
from pollweave.plans.sql import case, rounded
from pollweave.sources.tables import table

# The game clock of the progress queries: 1998-01-01T00:00:00Z.
NOW = 883_612_800


def decode_code(spark, sf):
    code = F.col("c_nationkey").cast("string")
    owner = normalize.decode_code(code, fixed.OWNER_CODES, fixed.UNKNOWN)
    mixed = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise(code)
    return (
        table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
        .withColumn("owner", owner)
        .withColumn("shown", normalize.canonical_faction(F.col("owner")))
        .select(
            "c_custkey",
            "owner",
            normalize.decode_code(code, fixed.SECTOR_CODES, "").alias("sector"),
            normalize.decode_code(mixed, fixed.OWNER_CODES, fixed.UNKNOWN).alias("label"),
            text.owner_colour(F.col("shown")).alias("colour"),
            text.contest_colour(F.col("owner")).alias("contest_colour"),
            text.race_colour(F.col("c_nationkey")).alias("race_colour"),
            text.local_owner(F.col("shown")).alias("local_name"),
        )
    )


_OWNER = case("c_nationkey", fixed.OWNER_CODES, "'Unknown'")
DECODE_CODE = f"""
WITH coded AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, {_OWNER} AS owner FROM customer
), shown AS (
  SELECT *, CASE owner WHEN 'Automaton' THEN 'Automatons' ELSE owner END AS shown FROM coded
)
SELECT c_custkey, owner,
  {case("c_nationkey", fixed.SECTOR_CODES, "''")} AS sector,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE owner END AS label,
  {case("shown", fixed.OWNER_COLOURS, "'" + fixed.OWNER_COLOUR_DEFAULT + "'")} AS colour,
  {case("owner", fixed.CONTEST_COLOURS, "'" + fixed.CONTEST_COLOUR_DEFAULT + "'")} AS contest_colour,
  {case("c_nationkey", fixed.RACE_CODE_COLOURS, "NULL")} AS race_colour,
  {case("shown", fixed.OWNER_LOCAL, "owner")} AS local_name
FROM shown
"""


def normalize_epoch(spark, sf):
    seconds = normalize.epoch_seconds(F.col("o_orderdate"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, seconds * 1000).otherwise(seconds)
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey",
        normalize.iso_epoch(raw).alias("published"),
        normalize.local_time(F.col("o_orderdate")).alias("published_local"),
    )


NORMALIZE_EPOCH = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published,
  strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS published_local
FROM orders
"""


def falsy_coalesce(spark, sf):
    return table(
        spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount"
    ).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        falsy.first_number(F.col("l_tax"), F.col("l_discount"), F.lit(0.01)).alias("rate"),
    )


FALSY_COALESCE = """
SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(nullif(l_tax, 0), nullif(l_discount, 0), CAST(0.01 AS DOUBLE)) AS rate
FROM lineitem
"""


def regen_rate(spark, sf):
    suppliers = table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    nations = suppliers.groupBy("s_nationkey").agg(
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("max_health")
    )
    return overlay.attach(suppliers, nations, ["s_nationkey"], "n_").select(
        "s_suppkey",
        metrics.regen_percent(F.col("s_acctbal") / 3600, F.col("n_max_health")).alias("resistance"),
    )


REGEN_RATE = f"""
SELECT s_suppkey, coalesce({rounded('s_acctbal / 3600 * 3600 / nullif(max_health, 0) * 100', 2)}, 0)
  AS resistance
FROM supplier LEFT JOIN (
  SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS max_health
  FROM supplier GROUP BY s_nationkey) USING (s_nationkey)
"""

_KINDS = {"purchase": "1", "error": "4", "signup": "defense", "click": "0", "view": "2"}


def classify_contest(spark, sf):
    kind = normalize.lookup(F.col("event_type"), _KINDS)
    event_kind = F.when(F.col("value") > 100, 1)
    contest = metrics.with_recon(
        kind, event_kind, F.col("user_id"), metrics.contest_class(kind)
    )
    return (
        table(spark, sf, "events", "event_type", "user_id", "value")
        .groupBy("event_type", contest.alias("contest_class"))
        .agg(F.count(F.lit(1)).alias("contests"))
    )


CLASSIFY_CONTEST = """
SELECT event_type,
  CASE WHEN event_type = 'purchase' AND NOT value > 100 THEN 'recon'
       WHEN event_type IN ('purchase', 'error', 'signup') THEN 'defense'
       ELSE 'liberation' END AS contest_class,
  count(*) AS contests
FROM events GROUP BY ALL
"""


def level_round(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_retailprice").select(
        "p_partkey", metrics.level(F.col("p_retailprice"), 50.0).alias("level")
    )


LEVEL_ROUND = """
SELECT p_partkey, CAST(round_even(p_retailprice / 50, 0) AS INTEGER) AS level FROM part
"""


def bounded_progress(spark, sf):
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        metrics.defender_progress(F.col("l_quantity"), F.lit(40.0)).alias("defenders_progress"),
    )


BOUNDED_PROGRESS = f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  {rounded('greatest(0, least(1, (40 - l_quantity) / 40)) * 100', 2)} AS defenders_progress
FROM lineitem
"""


def linear_progress(spark, sf):
    now = F.lit(NOW).cast("bigint")
    return (
        table(spark, sf, "orders", "o_orderkey", "o_orderdate")
        .withColumn("start", normalize.epoch_seconds(F.col("o_orderdate")))
        .withColumn("end", F.col("start") + 172800 * (1 + F.col("o_orderkey") % 5))
        .withColumn("attackers_rate", metrics.attacker_rate(F.col("start"), F.col("end")))
        .select(
            "o_orderkey",
            "attackers_rate",
            metrics.attacker_progress(F.col("attackers_rate"), F.col("start"), now).alias(
                "attackers_progress"
            ),
            metrics.remaining(F.col("end"), now).alias("remaining_time"),
        )
    )


LINEAR_PROGRESS = f"""
WITH spans AS (
  SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s,
    CAST(epoch(o_orderdate) AS BIGINT) + 172800 * (1 + o_orderkey % 5) AS e FROM orders
), rates AS (
  SELECT *, {rounded('100 / ((e - s) / 3600.0::DOUBLE)', 3)} AS rate FROM spans
)
SELECT o_orderkey, rate AS attackers_rate,
  CASE WHEN {NOW} > s THEN {rounded(f'least(100, rate * (({NOW} - s) / 3600.0::DOUBLE))', 2)} END
    AS attackers_progress,
  greatest(0, e - {NOW}) AS remaining_time
FROM rates
"""


def ratio_rates(spark, sf):
    def kind(name):
        return F.count_if(F.col("event_type") == name)

    totals = table(spark, sf, "events", "user_id", "event_type", "ts").groupBy("user_id").agg(
        kind("purchase").alias("won"),
        kind("error").alias("lost"),
        (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds"),
        kind("click").alias("clicks"),
        kind("view").alias("views"),
        kind("signup").alias("signups"),
    )
    ratios = metrics.ratio_columns(
        F.col("won"),
        F.col("lost"),
        F.col("seconds"),
        [F.col("clicks"), F.col("views"), F.col("signups")],
        F.col("lost"),
    )
    return totals.select("user_id", *[column.alias(name) for name, column in ratios.items()])


RATIO_RATES = f"""
WITH totals AS (
  SELECT user_id, count(*) FILTER (event_type = 'purchase') AS won,
    count(*) FILTER (event_type = 'error') AS lost,
    count(*) FILTER (event_type IN ('click', 'view', 'signup')) AS kills,
    nullif(CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT), 0) / 3600.0::DOUBLE AS h
  FROM events GROUP BY user_id)
SELECT user_id, {rounded('won / h', 2)} AS success_per_hour, {rounded('lost / h', 2)} AS fail_per_hour,
  {rounded('kills / h', 2)} AS enemies_per_hour, {rounded('lost / h', 2)} AS deaths_per_hour,
  {rounded('won / nullif(won + lost, 0) * 100', 4)} AS success_rate,
  {rounded('lost / nullif(won + lost, 0) * 100', 4)} AS fail_rate
FROM totals
"""


def progress_band(spark, sf):
    percent = metrics.health_percent(F.col("p_size") - 10, F.lit(40))
    return (
        table(spark, sf, "part", "p_size")
        .groupBy(F.coalesce(metrics.progress_band(percent), F.lit("none")).alias("band"))
        .agg(F.count(F.lit(1)).alias("nodes"), F.round(F.max(percent), 2).alias("max_percent"))
    )


PROGRESS_BAND = f"""
WITH p AS (SELECT greatest(0, least(100, (p_size - 10) / 40 * 100)) AS pct FROM part)
SELECT CASE WHEN pct > 50 THEN '{fixed.BAND_HIGH}' WHEN pct > 25 THEN '{fixed.BAND_MIDDLE}'
  WHEN pct > 0 THEN '{fixed.BAND_LOW}' ELSE 'none' END AS band,
  count(*) AS nodes, CAST(round(max(pct), 2) AS DOUBLE) AS max_percent
FROM p GROUP BY 1
"""


def format_summary(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = table(
        spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderpriority",
    ).withColumnRenamed("o_custkey", "c_custkey")
    owner = normalize.decode_code(
        F.col("c_c_nationkey").cast("string"), fixed.OWNER_CODES, fixed.UNKNOWN
    )
    state = F.when(F.col("o_orderstatus") == "F", fixed.DEFENSE).when(
        F.col("o_orderstatus") == "P", fixed.LIBERATION
    )
    maximum = F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(500000)
    return overlay.attach(orders, customers, ["c_custkey"], "c_").select(
        "o_orderkey",
        text.summary(
            F.col("c_c_name"), owner, state, F.col("c_c_mktsegment"), F.col("o_totalprice"),
            maximum, F.col("c_custkey"),
        ).alias("summary"),
    )


_LOCAL = case("c_nationkey", {
    code: fixed.OWNER_LOCAL[fixed.FACTION_ALIASES.get(label, label)]
    for code, label in fixed.OWNER_CODES.items()
}, "'Unknown'")
FORMAT_SUMMARY = f"""
SELECT o_orderkey, concat_ws(chr(10),
  '📍 ' || c_name,
  '阵营: ' || {_LOCAL},
  CASE o_orderstatus WHEN 'F' THEN '战况: 防御战' WHEN 'P' THEN '战况: 解放战' END,
  '星区: ' || c_mktsegment,
  '健康度: ' || CASE WHEN o_orderpriority = '5-LOW' THEN '--'
    ELSE printf('%.2f', o_totalprice / 500000 * 100
      + CASE WHEN (o_totalprice / 500000 * 800) % 2 = 1 THEN 0.001 ELSE 0 END) END || '%',
  '玩家: ' || o_custkey) AS summary
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""


def override_chain(spark, sf):
    priority = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        "o_orderkey",
        precedence.override(priority, status, default=fixed.ASSIGNMENT_TITLE).alias("title"),
    )


OVERRIDE_CHAIN = """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority
  WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'MAJOR ORDER' END AS title
FROM orders
"""

_EVENT_LABELS = {
    "click": "clicks", "error": "errors", "purchase": "purchases", "signup": "signups",
    "view": "views",
}


def reshape_record(spark, sf):
    days = table(spark, sf, "events", "ts", "event_type").select(
        F.to_date("ts").cast("string").alias("day"), "event_type"
    )
    wide = shaping.counts_record(days, ["day"], "event_type", _EVENT_LABELS)
    record = shaping.nest(
        wide, ["day"], "counts", list(_EVENT_LABELS.values()), players="total"
    )
    return record.select("day", "players", "counts.*")


RESHAPE_RECORD = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS players,
  count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'purchase') AS purchases,
  count(*) FILTER (event_type = 'signup') AS signups,
  count(*) FILTER (event_type = 'view') AS views
FROM events GROUP BY 1
"""


def time_bucket(spark, sf):
    return (
        table(spark, sf, "events", "ts", "event_id")
        .groupBy(normalize.time_bucket(F.col("ts")).alias("bucket"))
        .agg(F.count("event_id").alias("records"))
        .select(normalize.iso_seconds(F.unix_seconds("bucket")).alias("bucket"), "records")
    )


TIME_BUCKET = """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M:%SZ') AS bucket,
  count(event_id) AS records
FROM events GROUP BY 1
"""

QUERIES = {
    "decode_code": (decode_code, DECODE_CODE),
    "normalize_epoch": (normalize_epoch, NORMALIZE_EPOCH),
    "falsy_coalesce": (falsy_coalesce, FALSY_COALESCE),
    "regen_rate": (regen_rate, REGEN_RATE),
    "classify_contest": (classify_contest, CLASSIFY_CONTEST),
    "level_round": (level_round, LEVEL_ROUND),
    "bounded_progress": (bounded_progress, BOUNDED_PROGRESS),
    "linear_progress": (linear_progress, LINEAR_PROGRESS),
    "ratio_rates": (ratio_rates, RATIO_RATES),
    "progress_band": (progress_band, PROGRESS_BAND),
    "format_summary": (format_summary, FORMAT_SUMMARY),
    "override_chain": (override_chain, OVERRIDE_CHAIN),
    "reshape_record": (reshape_record, RESHAPE_RECORD),
    "time_bucket": (time_bucket, TIME_BUCKET),
}
