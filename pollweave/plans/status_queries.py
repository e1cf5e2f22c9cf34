"""Registered queries: the whole status job, on documents written from the tables.

Customers become entities. A poll holds CUSTOMERS of them; of three polls in a row one has
a whole primary source, one a primary source with a defective document, one none. The
other source has every poll. The documents go through the readers and ``reconcile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.plans import publishing, reconcile as rec
from pollweave.plans import status as st
from pollweave.plans.sql import rounded
from pollweave.session import run_folder, written
from pollweave.sources import documents as docs
from pollweave.sources.documents import POLL
from pollweave.sources.tables import table

CUSTOMERS = 512
_FIRST = 1_700_000_100


_landings: dict[tuple[str, str], str] = {}


def _landed(spark, sf) -> str:
    """The landing folder with the documents of both sources, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _landings:
        _landings[key] = _land(spark, sf)
    return _landings[key]


def _land(spark, sf) -> str:
    folder = run_folder(spark, "landed-status")
    k = F.col("k")
    customers = table(
        spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    ).select(
        F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_mktsegment",
        F.greatest(F.lit(0), F.floor("c_acctbal")).cast("bigint").alias("health"),
        F.floor(F.col("c_custkey") / CUSTOMERS).cast("bigint").alias("poll"),
    )

    def listed(rows: DataFrame, item: Column) -> DataFrame:
        return rows.groupBy("poll").agg(F.collect_list(item).alias("items"))

    def write(rows: DataFrame, name: str, value: Column) -> None:
        docs.archive(
            rows.select(value.alias("value"), (F.col("poll") * 300 + _FIRST).alias(POLL)),
            f"{folder}/{name}")

    def fields(**values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in values.items()])

    statistics = fields(
        missionsWon=k % 40, missionsLost=k % 7, missionTime=(k % 3) * 1800, terminidKills=k % 90,
        illuminateKills=k % 11, deaths=(k % 2) * (k % 9 + 1), helldiversDeaths=k % 13,
        accuracy=F.lit(87.5))
    biome = fields(name=F.col("c_mktsegment"), slug=F.lower("c_mktsegment"))
    planet = fields(
        hash=k * 7_000_000_007, biome=biome, hazards=F.array_repeat(fields(level=k % 9), (k % 3).cast("int")),
        disabled=F.when(k % 2 == 0, k % 4 == 0), note=F.concat(F.lit('é "'), k, F.lit('"\n')),
        index=k, name=F.col("c_name"), sector=F.col("c_mktsegment"),
        currentOwner=F.concat(F.lit("R"), "c_nationkey"), health=F.col("health"),
        maxHealth=k + 3_000_000, players=k % 60, statistics=statistics)
    contest = fields(
        id=k, type=F.when(k % 5 == 0, 1).otherwise(0), planet=fields(index=k, biome=biome),
        priority=k % 6)
    planets = listed(customers, planet)
    write(planets, "planets", F.to_json("items"))
    write(listed(customers.where(k % 5 < 2), contest), "campaigns", F.to_json("items"))
    polled = F.col("poll").cast("string")
    write(planets, "war", F.concat(
        F.lit('{"statistics": {"playerCount": 5, "shots": 1'), polled, F.lit('}, "now": "T'),
        polled, F.lit('"}')))
    write(planets, "assignments", F.lit("null"))
    write(planets, "dispatches", F.concat(
        F.lit('[{"id": 1, "message": "m", "author": {"name": "A'), polled,
        F.lit('"}}, {"id": 2}]')))

    some = customers.where(F.col("poll") % 3 < 2)
    state = fields(
        index=k, owner=F.col("c_nationkey"), health=F.col("health"),
        maxHealth=F.when(k % 4 == 0, 1).otherwise(k + 2_000_000), players=k % 50)
    info = fields(
        index=k, name=F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("P"), k)),
        sector=F.lit("Far"))
    campaign = fields(
        id=k, planetIndex=k, type=F.when(k % 5 == 0, 1).otherwise(0))
    both = listed(some, state).withColumnRenamed("items", "states").join(
        listed(some.where(k % 5 < 2), campaign), "poll")
    write(both, "status", F.to_json(fields(
        time=F.lit(1000), planetStatus=F.col("states"), campaigns=F.col("items"))))
    whole = F.col("poll") % 3 == 0
    infos = listed(some, info)
    write(infos, "info", F.when(whole, F.to_json(fields(planetInfos=F.col("items")))).otherwise("null"))
    for name in ("assignment", "stats", "news"):
        write(infos, name, F.lit("null"))
    return folder


def _status(spark, sf) -> rec.Status:
    landing = _landed(spark, sf)
    work = run_folder(spark, "status")
    return rec.reconcile(
        *[f(spark, landing, work) for f in (st.read_primary, st.read_aggregate, st.read_rest)])


def status_entities(spark, sf):
    return _status(spark, sf).entities.select(
        POLL, "entity_id", "source", "name", "sector", "owner", "health", "max_health", "players")


_POLLS = f"""
SELECT c_custkey AS k, c_custkey // {CUSTOMERS} AS poll,
  (c_custkey // {CUSTOMERS}) * 300 + {_FIRST} AS poll_ts, (c_custkey // {CUSTOMERS}) % 3 = 0 AS own,
  * FROM customer
"""

STATUS_ENTITIES = f"""
SELECT poll_ts, k AS entity_id, CASE WHEN own THEN 'primary' ELSE 'rest' END AS source,
  CASE WHEN own AND k % 10 <> 0 THEN 'P' || k ELSE c_name END AS name, c_mktsegment AS sector,
  CASE WHEN NOT own THEN 'R' || c_nationkey WHEN c_nationkey IN (0, 1) THEN 'Humans'
    WHEN c_nationkey = 2 THEN 'Terminids' WHEN c_nationkey = 3 THEN 'Automaton'
    WHEN c_nationkey = 4 THEN 'Illuminate' ELSE 'Unknown' END AS owner,
  greatest(0, CAST(floor(c_acctbal) AS BIGINT)) AS health,
  CASE WHEN own AND k % 4 <> 0 THEN k + 2000000 ELSE k + 3000000 END AS max_health,
  CASE WHEN own THEN k % 50 ELSE k % 60 END AS players
FROM ({_POLLS})
"""


def status_recon(spark, sf):
    return _status(spark, sf).recon


STATUS_RECON = f"""
WITH t AS (
  SELECT poll_ts, k AS entity_id, k % 40 AS won, k % 7 AS lost, k % 90 + k % 11 AS kills,
    CASE WHEN k % 2 = 1 THEN k % 9 + 1 ELSE k % 13 END AS deaths,
    nullif((k % 3) * 1800, 0) / 3600.0::DOUBLE AS h
  FROM ({_POLLS}) WHERE k % 5 = 0)
SELECT poll_ts, entity_id, {rounded('won / h', 2)} AS success_per_hour,
  {rounded('lost / h', 2)} AS fail_per_hour, {rounded('kills / h', 2)} AS enemies_per_hour,
  {rounded('deaths / h', 2)} AS deaths_per_hour,
  {rounded('won / nullif(won + lost, 0) * 100', 4)} AS success_rate,
  {rounded('lost / nullif(won + lost, 0) * 100', 4)} AS fail_rate
FROM t
"""

def rest_passthrough(spark, sf):
    """Fields of the rest source that the job doesn't know, out of the published documents."""
    documents = written(publishing.poll_documents(_status(spark, sf)).select(
        POLL, F.parse_json("document").alias("d")), "documents")  # read by each kind of row

    def listed(name: str) -> DataFrame:
        rows = F.variant_get("d", f"$.{name}", "array<variant>")
        return documents.select(POLL, F.explode(rows).alias("r"))

    def told(rows: DataFrame, kind: str, *paths: str, of: str = "$.index") -> DataFrame:
        texts = [F.coalesce(F.to_json(F.try_variant_get("r", f"$.{p}", "variant")), F.lit("-"))
                 for p in paths]
        return rows.select(
            POLL, F.lit(kind).alias("kind"), F.try_variant_get("r", of, "bigint").alias("id"),
            F.concat_ws(" ", *texts).alias("fields"))

    whole = documents.select(POLL, F.variant_get("d", "$.war", "variant").alias("r"))
    return (
        told(listed("planets"), "planet", "hash", "biome", "hazards", "disabled", "note",
             "statistics.accuracy", "maxHealth")
        .unionByName(told(listed("campaigns"), "contest", "priority", "planet.biome", of="$.id"))
        .unionByName(told(listed("dispatches"), "bulletin", "author", "message", of="$.id"))
        .unionByName(told(whole, "war", "now", "statistics.shots", "statistics.playerCount",
                          of="$.time"))
    )


_BIOME = """'{"name":"' || c_mktsegment || '","slug":"' || lower(c_mktsegment) || '"}'"""
REST_PASSTHROUGH = f"""
SELECT poll_ts, 'planet' AS kind, k AS id, CASE WHEN own THEN '- - - - - - ' || CASE
    WHEN k % 4 <> 0 THEN k + 2000000 ELSE k + 3000000 END
  ELSE concat_ws(' ', k * 7000000007, {_BIOME}, CASE k % 3 WHEN 0 THEN '[]'
    WHEN 1 THEN '[{{"level":' || k % 9 || '}}]'
    ELSE '[{{"level":' || k % 9 || '}},{{"level":' || k % 9 || '}}]' END,
    CASE WHEN k % 2 = 1 THEN '-' WHEN k % 4 = 0 THEN 'true' ELSE 'false' END,
    '"é \\"' || k || '\\"\\n"', '87.5', k + 3000000) END AS fields
FROM ({_POLLS})
UNION ALL
SELECT poll_ts, 'contest', k, CASE WHEN own THEN '- -' ELSE k % 6 || ' ' || {_BIOME} END
FROM ({_POLLS}) WHERE k % 5 < 2
UNION ALL
SELECT DISTINCT poll_ts, 'bulletin', 1, '{{"name":"A' || poll || '"}} "m"' FROM ({_POLLS})
UNION ALL
SELECT DISTINCT poll_ts, 'bulletin', 2, '- null' FROM ({_POLLS})
UNION ALL
SELECT DISTINCT poll_ts, 'war', CASE WHEN own THEN 1000 ELSE 0 END, CASE WHEN own THEN '- - 5'
  ELSE '"T' || poll || '" 1' || poll || ' 5' END
FROM ({_POLLS})
"""

QUERIES = {
    "rest_passthrough": (rest_passthrough, REST_PASSTHROUGH),
    "status_entities": (status_entities, STATUS_ENTITIES),
    "status_recon": (status_recon, STATUS_RECON),
}
