"""Registered queries: the whole status job with every source, events, and what is carried.

A poll holds ENTITIES of the parts, the same ones in every poll. Of four polls in a row the
first has all sources, the second the primary source alone, the third the aggregate and the
rest source, the fourth the rest source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.plans import reconcile as rec
from pollweave.plans import status as st
from pollweave.plans.sql import rounded
from pollweave.plans.translation import owned_columns
from pollweave.session import run_folder
from pollweave.sources import documents as docs
from pollweave.sources.documents import POLL
from pollweave.sources.tables import table

ENTITIES = 500
_FIRST = 1_700_000_000
_HOUR = 3600
_landings: dict[tuple[str, str], str] = {}


def _landed(spark, sf) -> str:
    """The landing folder with the documents of all sources, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _landings:
        _landings[key] = _land(spark, sf)
    return _landings[key]


def _fields(**values: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in values.items()])


def _land(spark, sf) -> str:
    folder = run_folder(spark, "landed-war")
    k, e, p = F.col("k"), F.col("e"), F.col("p")
    parts = table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("k"), (F.col("p_partkey") % ENTITIES).alias("e"),
        F.floor(F.col("p_partkey") / ENTITIES).alias("p"))
    when = lambda condition, value: F.when(condition, value)
    text = lambda *parts: F.concat(*[
        F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    state = _fields(
        index=e, owner=e % 5, health=(k * 37) % 9000 + 1,
        maxHealth=F.when(e % 4 == 0, 1).otherwise(500_000 + e * 1000), players=e % 50,
        regenPerSecond=(e % 3) / 2)
    event = _fields(
        id=900_000 + k, planetIndex=e, eventType=F.lit(1), race=1 + F.floor(e / 20) % 4,
        health=F.when(e % 40 == 0, 0).otherwise((k * 7919) % 1_000_000 + 1),
        maxHealth=F.when(e % 100 == 0, 0).otherwise(1_000_000), startTime=F.lit(1000),
        expireTime=F.when(e % 60 == 0, 0).otherwise(173_800))
    live_state = _fields(
        index=e, owner=(e + 1) % 5, health=(k * 11) % 7000 + 1, players=e % 6 * 10,
        regenPerSecond=(e % 4) / 4)
    live_event = _fields(
        id=800_000 + k, planetIndex=e, eventType=F.lit(2), race=F.lit(3), health=250_000 + e,
        maxHealth=F.lit(500_000), startTime=F.lit(1000), expireTime=F.lit(173_800))
    planet = _fields(
        index=e, name=text("R", e), sector=text("Q", e % 6), currentOwner=text("C", e % 3),
        health=e + 1, maxHealth=F.when(e % 8 == 0, 0).otherwise(2_000_000 + e), players=e % 30)
    contest = _fields(
        id=k, faction=text("F", e % 3), type=e % 3, eventType=when(e % 10 == 1, F.lit(1)),
        campaignType=F.lit("x"), count=e % 4, defendersProgress=(k % 1000) / 10,
        planet=_fields(
            index=e, name=F.when(e % 2 == 0, text("PLANET_", e)).otherwise(text("N", e)),
            sector=F.lit("Z"), currentOwner=F.lit("O")))
    listed = lambda item, condition=None: F.collect_list(
        item if condition is None else F.when(condition, item))
    rows = parts.groupBy("p").agg(
        listed(state).alias("states"),
        listed(event, e % 20 == 0).alias("events"),
        listed(_fields(id=k, planetIndex=e, faction=e % 4, type=F.floor(e / 10) % 3,
                       campaignId=e % 7), e % 10 == 0).alias("campaigns"),
        listed(_fields(planetIndex=e, galacticEffectId=p), e % 25 == 0).alias("effects"),
        listed(_fields(index=e, name=F.when(e % 3 == 0, "").otherwise(text("P", e)),
                       sector=text("S", e % 9))).alias("infos"),
        listed(live_state).alias("live_states"),
        listed(live_event, e % 50 == 0).alias("live_events"),
        listed(_fields(id=k, planetIndex=e, race=e % 4, type=F.lit(0), count=e % 8),
               e % 10 == 0).alias("live_campaigns"),
        listed(_fields(index=e, galacticEffectId=700 + p),
               e % 25 == F.when(p % 4 == 0, 5).otherwise(7)).alias("live_effects"),
        listed(planet).alias("planets"),
        listed(contest, e % 10 < 2).alias("contests"),
    )
    rows = rows.withColumn("m", p % 4).cache()
    some = lambda condition, item: F.when(condition, F.array(item)).otherwise(
        F.array())

    def write(polls: DataFrame, name: str, value: Column) -> None:
        docs.archive(
            polls.select(value.alias("value"), (p * _HOUR + _FIRST).alias(POLL)),
            f"{folder}/{name}")

    clock = 1000 + _HOUR * p
    own = rows.where("m < 2")
    write(own, "status", F.to_json(_fields(
        time=clock, planetStatus=F.col("states"), planetActiveEffects=F.col("effects"),
        campaigns=F.col("campaigns"), planetEvents=F.col("events"),
        spaceStations=some(p % 5 != 1, _fields(
            planetIndex=p, activeEffectIds=F.array(p, F.lit(1).cast("bigint")),
            currentElectionEndWarTime=1_724_000_000 + p)))))
    write(own, "info", F.to_json(_fields(planetInfos=F.col("infos"))))
    write(own, "assignment", F.to_json(some(p % 3 != 0, _fields(
        id32=7000 + p, briefing=text("b", p), progress=F.array(p),
        expiration=1_724_000_000 + p))))
    write(own, "stats", F.lit('{"started": "s", "ended": "e"}'))
    write(own, "news", F.to_json(F.array(
        _fields(id=p, published=1_724_000_000 + p, type=F.lit(0), message=text("n", p)))))
    live = rows.where("m in (0, 2)")
    write(live, "live", F.to_json(_fields(
        warStatus=_fields(
            time=clock, planetStatus=F.col("live_states"),
            planetActiveEffects=F.col("live_effects"), campaigns=F.col("live_campaigns"),
            planetEvents=F.col("live_events")),
        majorOrders=some(p % 8 == 0, _fields(
            id32=88_000 + p, setting=_fields(
                overrideTitle=text("T", p), tasks=F.array(_fields(a=p))))),
        news=F.array(_fields(id=500 + p, published=F.lit(3), message=text("agg", p))),
        spaceStations=F.array(_fields(planetIndex=100 + p)))))
    rest = rows.where("m <> 1")
    write(rest, "planets", F.to_json("planets"))
    write(rest, "campaigns", F.to_json("contests"))
    write(rest, "war", F.to_json(_fields(statistics=_fields(playerCount=1234 + p))))
    write(rest, "assignments", F.to_json(some(F.col("m") != 2, _fields(
        id=6000 + p, title=text("R", p), expiration=text("2024-09-0", 1 + p % 9, "T00:00:00Z")))))
    write(rest, "dispatches", F.to_json(some(F.col("m") != 2, _fields(
        id=p, published=text("2024-08-0", 1 + p % 9), type=F.lit(1), message=text("r", p)))))
    write(rows, "series", F.to_json(_fields(data=F.array(*[
        _fields(timestampUtc=text("t", 10_000 + F.floor(p / 2) * 2 - older), totalPlayerCount=p + 7,
                playerCountHumans=p, playerCountTerminids=p % 3, impactMultiplier=p / 4)
        for older in (1, 0)]))))
    write(rows.where("p % 3 < 2"), "translated", F.when(p % 3 == 1, F.lit("not json")).otherwise(
        F.to_json(_fields(
            mo_brief=_fields(title=text("M", p), translated=text("x", p)),
            items=F.array(_fields(id=p, translated=text("n", p), source=F.lit("s")))))))
    rows.unpersist()
    return folder


def _sources(spark, sf) -> list[st.Source]:
    landing, work = _landed(spark, sf), run_folder(spark, "war")
    return [f(spark, landing, work) for f in (st.read_primary, st.read_aggregate, st.read_rest)]


_POLLS = f"""
rows AS (
  SELECT p_partkey AS k, p_partkey % {ENTITIES} AS e, p_partkey // {ENTITIES} AS p,
    p_partkey // {ENTITIES} % 4 AS m FROM part
), polls AS (
  SELECT DISTINCT p, m, p * {_HOUR} + {_FIRST} AS poll_ts,
    CASE WHEN m < 2 THEN 'primary' WHEN m = 2 THEN 'aggregate' ELSE 'rest' END AS source
  FROM rows
)"""


def _owner(code: str) -> str:
    return (f"CASE {code} WHEN 2 THEN 'Terminids' WHEN 3 THEN 'Automaton' "
            f"WHEN 4 THEN 'Illuminate' ELSE 'Humans' END")


def status_contests(spark, sf):
    return rec.reconcile(*_sources(spark, sf)).contests.select(
        POLL, "entity_id", "source", "contest_id", "faction", "type", "event_kind",
        "contest_class", "attackers_progress", "defenders_progress", "attackers_rate",
        "defenders_rate", "start_time", "remaining_time", "level", "count", "name", "sector",
        "owner")


STATUS_CONTESTS = f"""
WITH {_POLLS}, plain AS (
  SELECT p, e, 1 AS place, k AS contest_id,
    CASE WHEN e % 4 = 0 THEN 'Humans' ELSE 'Terminids' END AS faction,
    CAST(e // 10 % 3 AS VARCHAR) AS type, NULL::BIGINT AS event_kind,
    CASE WHEN e // 10 % 3 = 1 THEN 'recon' ELSE 'liberation' END AS contest_class,
    NULL::BIGINT AS most, NULL::BIGINT AS health, NULL::DOUBLE AS sent, NULL::BIGINT AS stop,
    e % 7 AS count, {_owner('e % 5')} AS owner
  FROM rows WHERE m < 2 AND e % 10 = 0 AND e % 20 <> 0
  UNION ALL
  SELECT p, e, 2, 900000 + k, {_owner('1 + e // 20 % 4')}, 'defense', 1, 'defense',
    CASE WHEN e % 100 = 0 THEN 1 ELSE 1000000 END,
    CASE WHEN e % 40 = 0 THEN (k * 37) % 9000 + 1 ELSE (k * 7919) % 1000000 + 1 END, NULL,
    CASE WHEN e % 60 = 0 THEN 0 ELSE 173800 END, 0, {_owner('e % 5')}
  FROM rows WHERE m < 2 AND e % 20 = 0
  UNION ALL
  SELECT p, e, 1, k, CASE WHEN e % 4 = 0 THEN 'Humans' ELSE 'Terminids' END, '0', NULL, NULL,
    NULL, NULL, NULL, NULL, e % 8, 'Humans'
  FROM rows WHERE m = 2 AND e % 10 = 0
  UNION ALL
  SELECT p, e, 2, 800000 + k, 'Automaton', 'defense', 2, 'defense', 500000, 250000 + e, NULL,
    173800, 0, 'Humans'
  FROM rows WHERE m = 2 AND e % 50 = 0
  UNION ALL
  SELECT p, e, 1, k, 'F' || e % 3, CAST(e % 3 AS VARCHAR),
    CASE WHEN e % 10 = 1 THEN 1 END,
    CASE WHEN e % 3 = 1 AND e % 10 <> 1 THEN 'recon' ELSE 'x' END, NULL, NULL,
    (k % 1000) / 10, NULL, e % 4, 'O'
  FROM rows WHERE m = 3 AND e % 10 < 2
), known AS (
  SELECT c.*, {_HOUR} * p + 1000 AS clock, CASE WHEN most IS NULL THEN sent ELSE
      {rounded('greatest(0.0, least(1.0, (most - health) / most)) * 100', 2)} END AS progress,
    CASE WHEN most IS NOT NULL AND stop > 0 THEN 2.083::DOUBLE END AS rate
  FROM plain c
), last AS (
  SELECT p, e, arg_max(coalesce(progress, -1), place) AS progress FROM known GROUP BY p, e
)
SELECT t.poll_ts, c.e AS entity_id, t.source, contest_id, faction, type, event_kind,
  contest_class, CASE WHEN rate IS NOT NULL AND clock > 1000 THEN
    {rounded('least(100.0, rate * ((clock - 1000) / 3600))', 2)} END AS attackers_progress,
  c.progress AS defenders_progress, rate AS attackers_rate,
  CASE WHEN (type = 'defense' OR event_kind = 1) AND l.progress >= 0
    AND abs(c.progress - l.progress) > 0.01
    THEN {rounded('c.progress - l.progress', 3)} END AS defenders_rate,
  CASE WHEN most IS NOT NULL THEN 1000::BIGINT END AS start_time,
  CASE WHEN most IS NOT NULL AND stop > 0 THEN greatest(0, stop - clock) END AS remaining_time,
  CAST(round_even(most / 50000, 0) AS INTEGER) AS level, count,
  CASE WHEN m = 3 AND c.e % 2 = 1 THEN 'N' || c.e
    WHEN m < 2 AND c.e % 3 <> 0 THEN 'P' || c.e
    WHEN m = 1 THEN 'PLANET_' || c.e ELSE 'R' || c.e END AS name,
  CASE WHEN m = 1 THEN 'S' || c.e % 9 ELSE 'Q' || c.e % 6 END AS sector, owner
FROM known c JOIN polls t ON c.p = t.p LEFT JOIN last l ON l.p = c.p - 1 AND l.e = c.e
"""


def status_resumed(spark, sf):
    """The job in two runs: the second starts from the state that the first has saved."""
    sources = _sources(spark, sf)
    folder = run_folder(spark, "war-state")
    middle = _FIRST + 2 * _HOUR
    found = None
    for version, now in enumerate((F.col(POLL) < middle, F.col(POLL) >= middle)):
        carried = rec.load_carried(spark, folder, version)
        try:
            status = rec.reconcile(*[s.filtered(now) for s in sources], carried)
        except rec.NoSource:
            continue
        rec.save_carried(rec.carry_over(status, carried), folder, version)
        found = status.entities if found is None else found.unionByName(status.entities)
    return found.select(
        POLL, "entity_id", "source", "name", "sector", "owner", "health", "max_health",
        "players", "resistance", F.array_join("effects", ",").alias("effects"))


STATUS_RESUMED = f"""
WITH {_POLLS}, given AS (
  SELECT *, CASE WHEN m = 2 THEN (k * 11) % 7000 + 1 WHEN m = 3 THEN e + 1
      ELSE (k * 37) % 9000 + 1 END AS health,
    CASE WHEN m < 2 AND e % 4 <> 0 THEN 500000 + e * 1000
      WHEN m = 1 THEN 1 WHEN e % 8 <> 0 THEN 2000000 + e WHEN m = 0 THEN 1 ELSE 0 END AS most,
    CASE WHEN m = 0 AND e % 25 = 5 OR m = 2 AND e % 25 = 7 THEN 700 + p
      WHEN m < 2 AND e % 25 = 0 THEN p END AS effect,
    CASE WHEN m = 1 THEN (e % 3) / 2 WHEN m = 3 THEN 0 ELSE (e % 4) / 4 END AS regen
  FROM rows
), kept AS (
  SELECT *, last_value(CASE WHEN most >= 1000 THEN most END IGNORE NULLS) OVER before AS good,
    last_value(effect IGNORE NULLS) OVER before AS seen
  FROM given WINDOW before AS (PARTITION BY e ORDER BY p ROWS UNBOUNDED PRECEDING)
), settled AS (
  SELECT *, CASE WHEN most >= 1000 THEN most ELSE coalesce(good, health) END AS max_health FROM kept
)
SELECT t.poll_ts, e AS entity_id, t.source,
  CASE WHEN s.m < 2 AND e % 3 <> 0 THEN 'P' || e WHEN s.m = 1 THEN 'PLANET_' || e
    ELSE 'R' || e END AS name,
  CASE WHEN s.m = 1 THEN 'S' || e % 9 ELSE 'Q' || e % 6 END AS sector,
  CASE WHEN s.m = 3 THEN 'C' || e % 3 WHEN s.m = 2 THEN {_owner('(e + 1) % 5')}
    ELSE {_owner('e % 5')} END AS owner, health, max_health,
  CASE WHEN s.m = 3 THEN e % 30 WHEN s.m = 1 THEN e % 50 WHEN s.m = 0 AND e % 6 = 0 THEN e % 50
    ELSE e % 6 * 10 END AS players,
  {rounded('regen * 3600 / max_health * 100', 2)} AS resistance,
  coalesce(CAST(CASE WHEN s.m IN (0, 2) THEN effect ELSE seen END AS VARCHAR), '') AS effects
FROM settled s JOIN polls t ON s.p = t.p
"""


def status_singletons(spark, sf):
    """Assignment, station, war and bulletins of every poll, a text per record."""
    status = rec.reconcile(*_sources(spark, sf))

    def told(rows: DataFrame, kind: str, *columns: Column | str) -> DataFrame:
        shown = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("-"))
                 for c in columns]
        return rows.select(POLL, F.lit(kind).alias("kind"), F.concat_ws("|", *shown).alias("told"))

    return (
        told(status.assignments, "assignment", "id", "briefing", "title", "tasks",
             F.array_join("progress", ","), "expiration", "deadline", "server_time", "source")
        .unionByName(told(status.stations, "station", "entity_id", F.array_join("effects", ","),
                          "election_end", "source"))
        .unionByName(told(status.war, "war", "time", "players", "started", "ended", "source"))
        .unionByName(told(status.bulletins, "bulletin", "id", "published", "type", "message"))
    )


_ISO = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
STATUS_SINGLETONS = f"""
WITH {_POLLS}, assignments AS (
  SELECT *, CASE WHEN m IN (0, 3) THEN '2024-09-0' || (1 + p % 9) || 'T00:00:00Z' ELSE '' END AS due
  FROM polls
), assigned AS (
  SELECT p, CASE
    WHEN m IN (0, 2) AND p % 8 = 0 THEN concat_ws('|', 88000 + p, '', 'T' || p,
      '[{{"a":' || p || '}}]', '', '')
    WHEN m < 2 AND p % 3 <> 0 THEN concat_ws('|', 7000 + p, 'b' || p, 'MAJOR ORDER', '[]', p,
      {_ISO.format('1724000000 + p')})
    WHEN m IN (0, 3) THEN concat_ws('|', 6000 + p, '', 'R' || p, '[]', '', due)
    END || '|' || due || '|' || CASE WHEN due = '' THEN '' ELSE {_ISO.format('poll_ts')} END || '|'
    || CASE WHEN m IN (0, 2) AND p % 8 = 0 THEN 'aggregate' WHEN m < 2 AND p % 3 <> 0 THEN 'primary'
      ELSE 'rest' END AS told
  FROM assignments
), stations AS (
  SELECT p, CASE WHEN m < 2 AND p % 5 <> 1 THEN concat_ws('|', p, p || ',1',
      {_ISO.format('1724000000 + p')}, 'primary')
    WHEN m IN (0, 2) THEN concat_ws('|', 100 + p, '', '', 'aggregate') END AS told
  FROM polls
), carried AS (
  SELECT p, 'assignment' AS kind, last_value(told IGNORE NULLS) OVER (ORDER BY p) AS told
  FROM assigned
  UNION ALL
  SELECT p, 'station', last_value(told IGNORE NULLS) OVER (ORDER BY p) FROM stations
  UNION ALL
  SELECT t.p, 'war', concat_ws('|', CASE WHEN t.m = 3 THEN 0 ELSE {_HOUR} * t.p + 1000 END,
    CASE WHEN t.m IN (0, 2) THEN
      (SELECT sum(e % 6 * 10) FROM rows r WHERE r.p = t.p)::BIGINT
      WHEN t.m = 3 THEN 1234 + t.p ELSE 0 END,
    CASE WHEN t.m < 2 THEN 's' ELSE '-' END, CASE WHEN t.m < 2 THEN 'e' ELSE '-' END, t.source)
  FROM polls t
  UNION ALL
  SELECT p, 'bulletin', CASE WHEN m = 2 THEN concat_ws('|', 500 + p, '', '-', 'agg' || p)
    WHEN m = 1 THEN concat_ws('|', p, {_ISO.format('1724000000 + p')}, '0', 'n' || p)
    ELSE concat_ws('|', p, '2024-08-0' || (1 + p % 9), '1', 'r' || p) END
  FROM polls
)
SELECT poll_ts, kind, told FROM carried JOIN polls USING (p) WHERE told IS NOT NULL
"""


def status_series(spark, sf):
    """The bounded history of the time series: one record per new timestamp."""
    history = st.series_history(st.read_series(spark, _landed(spark, sf)))
    return history.select("timestamp", "total_players", "factions.*", "impact_multiplier")


STATUS_SERIES = f"""
WITH {_POLLS}
SELECT 't' || (10000 + p // 2 * 2) AS timestamp, p + 7 AS total_players, p AS "Humans",
  p % 3 AS "Terminids", 0::BIGINT AS "Automatons", 0::BIGINT AS "Illuminate",
  p / 4 AS impact_multiplier
FROM polls WHERE p % 2 = 0 ORDER BY p DESC LIMIT 288
"""


def translated_polls(spark, sf):
    """The translation job: what it owns of every poll, the poll before's where none arrived."""
    landing = _landed(spark, sf)
    polls = docs.read_documents(spark, f"{landing}/series", docs.SERIES).select(POLL)
    translations = docs.read_documents(spark, f"{landing}/translated", docs.TRANSLATIONS)
    return owned_columns(polls, translations).select(
        POLL, "major_order.title", "major_order.brief", "major_order.translated_brief",
        F.to_json("news").alias("news"))


TRANSLATED_POLLS = f"""
WITH {_POLLS}
SELECT poll_ts, 'M' || (p - p % 3) AS title, '' AS brief, 'x' || (p - p % 3) AS translated_brief,
  '[{{"id":' || (p - p % 3) || ',"translated":"n' || (p - p % 3) || '","source":"s"}}]' AS news
FROM polls
"""

QUERIES = {
    "status_contests": (status_contests, STATUS_CONTESTS),
    "status_resumed": (status_resumed, STATUS_RESUMED),
    "status_singletons": (status_singletons, STATUS_SINGLETONS),
    "status_series": (status_series, STATUS_SERIES),
    "translated_polls": (translated_polls, TRANSLATED_POLLS),
}
