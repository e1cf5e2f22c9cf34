"""The status job: three sources of polls to one reconciled picture per poll.

Sources are ``primary`` (five documents per poll), ``aggregate`` (one nested
document) and ``rest`` (five row-shaped documents); ``series`` is the player time
series. Each is read into the same tables, keyed by ``(poll_ts, source, ...)``, and
``reconcile`` settles them for all polls at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pollweave.functions import falsy, fixed, metrics, normalize
from pollweave.operators import history, overlay, precedence, shaping
from pollweave.session import run_folder
from pollweave.sources import documents as docs
from pollweave.sources.documents import POLL

PRIMARY, AGGREGATE, REST = "primary", "aggregate", "rest"
KEYS = [POLL, "entity_id"]

# The documents each source leaves per poll.
PRIMARY_DOCUMENTS = {
    "status": docs.STATUS,
    "info": docs.INFO,
    "assignment": docs.ASSIGNMENTS,
    "stats": docs.STATS,
    "news": docs.NEWS,
}
# Documents that their readers also take as JSON null.
PRIMARY_NULLABLE = frozenset({"assignment", "stats", "news"})
REST_NULLABLE = frozenset({"assignments"})
AGGREGATE_DOCUMENTS = {
    "live": docs.LIVE,
}
REST_DOCUMENTS = {
    "war": docs.WAR,
    "planets": docs.ENTITIES,
    "campaigns": docs.CONTESTS,
    "assignments": docs.ASSIGNMENTS,
    "dispatches": docs.NEWS,
}
# The fields that the published rows and documents write themselves. Whatever
# else the rest source sends with such a row is passed on as it came.
ENTITY_FIELDS = (
    "index", "name", "sector", "currentOwner", "health", "maxHealth", "players", "attacking",
    "resistance", "activeEffects",
)
CONTEST_FIELDS = (
    "id", "faction", "type", "eventType", "campaignType", "attackersProgress",
    "defendersProgress", "attackersRate", "defendersRate", "startTime", "remainingTime",
    "invasionLevel", "count", "planet",
)
PLACE_FIELDS = ("index", "name", "sector", "currentOwner")
BULLETIN_FIELDS = ("id", "published", "type", "message")
WAR_FIELDS = ("time", "statistics", "started", "ended")
WAR_STATISTICS = ("playerCount", "missionsWon", "missionsLost")
REST_EXTRAS = {
    "war": lambda value: F.struct(
        docs.remainder(value, WAR_FIELDS).alias("own"),
        docs.remainder(value, WAR_STATISTICS, "$.statistics").alias("statistics"),
    ),
    "planets": lambda value: docs.remainders(value, own=("$", ENTITY_FIELDS)),
    "campaigns": lambda value: docs.remainders(
        value, own=("$", CONTEST_FIELDS), planet=("$.planet", PLACE_FIELDS)),
    "dispatches": lambda value: docs.remainders(value, own=("$", BULLETIN_FIELDS)),
}


@dataclass
class Source:
    """One source's tables. ``polls`` lists the polls it delivered completely."""

    polls: DataFrame
    entities: DataFrame
    contests: DataFrame
    assignments: DataFrame
    bulletins: DataFrame
    war: DataFrame
    stations: DataFrame | None = None
    statistics: DataFrame | None = None

    def complete(self, work: str) -> Source:
        """Only the polls that arrived completely: a source counts as a whole or not at all.

        The tables are written under ``work`` once; everything later reads them there.
        """
        polls = docs.rewritten({"polls": self.polls}, work)["polls"]
        tables = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "polls"}
        present = {
            name: table.join(polls, POLL, "left_semi")
            for name, table in tables.items()
            if table is not None
        }
        return Source(polls=polls, **{**tables, **docs.rewritten(present, work)})

    def at(self, poll: int) -> Source:
        """The tables of one poll, for a run per poll."""
        return self.filtered(F.col(POLL) == poll)

    def filtered(self, polls: Column) -> Source:
        """The tables of the polls that a condition on ``poll_ts`` takes."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return Source(**{n: t if t is None else t.where(polls) for n, t in tables.items()})


class Status:
    """The reconciled tables, one row set per poll: ``polls`` and ``TABLES``.

    A table is worked out when it is first asked for, so a reader of one of them does not
    pay for the others.
    """

    TABLES = ("entities", "contests", "bulletins", "assignments", "stations", "war", "recon")

    def __init__(self, polls: DataFrame, **tables: Callable[[], DataFrame]) -> None:
        if set(tables) != set(self.TABLES):
            raise ValueError("a status has the tables " + ", ".join(self.TABLES))
        self.polls = polls
        self._tables = tables
        self._found: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Status.TABLES:
            raise AttributeError(name)
        if name not in self._found:
            self._found[name] = self._tables[name]()
        return self._found[name]


# ---- the primary source ----


def read_primary(
    spark: SparkSession, landing: str, work: str | None = None, since: int | None = None
) -> Source:
    """The primary source's polls from ``since`` on; ``work`` is a folder in the shared storage."""
    work = f"{work or run_folder(spark, 'status')}/primary"
    staged = docs.stage(
        spark, landing, PRIMARY_DOCUMENTS, f"{work}/documents", since, PRIMARY_NULLABLE)
    status, info, assignment, stats, news = (staged[name] for name in PRIMARY_DOCUMENTS)
    polls = docs.polls_of(status, info, assignment, stats, news)

    infos = _info_rows(info)
    states = _state_rows(status, F.col("doc.planetStatus"))
    effects = _effect_rows(status, F.col("doc.planetActiveEffects"), F.col("item.planetIndex"))
    entities = (
        infos.join(states, KEYS, "full_outer")
        .join(effects, KEYS, "left")
        .select(
            *KEYS,
            falsy.first_text(F.col("name"), normalize.synthetic_name(F.col("entity_id"))).alias(
                "name"
            ),
            F.coalesce("sector", F.lit("")).alias("sector"),
            F.coalesce("owner", F.lit(fixed.UNKNOWN)).alias("owner"),
            F.coalesce("health", F.lit(0)).alias("health"),
            falsy.first_number(F.col("max_health"), F.lit(1)).alias("max_health"),
            F.coalesce("players", F.lit(0)).alias("players"),
            F.coalesce("attacking", F.lit(False)).alias("attacking"),
            F.coalesce("regen", F.lit(0.0)).alias("regen"),
            F.coalesce("effects", F.array().cast("array<bigint>")).alias("effects"),
        )
    )
    contests = _dedupe(
        _plain_contests(status, F.col("doc.campaigns"), infos, states, classify=True).unionByName(
            _event_contests(status, F.col("doc"), infos, states, use_state=True)
        )
    )
    first = shaping.first_item(F.col("doc"))
    setting = first["setting"]
    assignments = assignment.select(POLL, first.alias("a"), setting.alias("s")).where(
        F.col("a").isNotNull()
    )
    assignments = assignments.select(
        POLL,
        falsy.first_number(F.col("a.id32"), F.col("a.id")).alias("id"),
        precedence.override(F.col("s.overrideBrief"), F.col("a.briefing"), default="").alias(
            "briefing"
        ),
        precedence.override(F.col("s.overrideTitle"), default=fixed.ASSIGNMENT_TITLE).alias("title"),
        _tasks(F.col("s.tasks"), F.col("a.tasks")).alias("tasks"),
        F.coalesce("a.progress", F.array().cast("array<bigint>")).alias("progress"),
        normalize.iso_variant(F.col("a.expiration")).alias("expiration"),
        F.lit("").alias("deadline"),
    )
    war = stats.join(status.select(POLL, F.col("doc.time").alias("time")), POLL).select(
        POLL,
        F.coalesce("time", F.lit(0)).alias("time"),
        F.coalesce("doc.statistics.playerCount", F.lit(0)).alias("players"),
        *_no_missions(),
        F.col("doc.started").alias("started"),
        F.col("doc.ended").alias("ended"),
    )
    return Source(
        polls=polls,
        entities=entities,
        contests=contests,
        assignments=assignments,
        bulletins=_bulletins(docs.items(news, F.col("doc")), in_order=True),
        war=war,
        stations=_stations(status, F.col("doc.spaceStations")),
    ).complete(work)


# ---- the aggregate source ----


def read_aggregate(
    spark: SparkSession, landing: str, work: str | None = None, since: int | None = None
) -> Source:
    """The aggregate source's polls from ``since`` on; ``work`` is a folder in the shared storage."""
    work = f"{work or run_folder(spark, 'status')}/aggregate"
    staged = docs.stage(spark, landing, AGGREGATE_DOCUMENTS, f"{work}/documents", since)
    live = staged["live"]
    status = live.select(POLL, F.col("doc.warStatus").alias("doc"))
    states = _state_rows(status, F.col("doc.planetStatus"))
    effect_id = F.coalesce("item.index", "item.planetIndex")
    effects = _effect_rows(status, F.col("doc.planetActiveEffects"), effect_id)
    nameless = states.select(
        *KEYS, F.lit(None).cast("string").alias("name"), F.lit("").alias("sector")
    )
    entities = states.join(effects, KEYS, "left").select(
        *KEYS,
        normalize.synthetic_name(F.col("entity_id")).alias("name"),
        F.lit("").alias("sector"),
        "owner",
        F.coalesce("health", F.lit(0)).alias("health"),
        F.lit(0).cast("bigint").alias("max_health"),
        F.coalesce("players", F.lit(0)).alias("players"),
        F.coalesce("attacking", F.lit(False)).alias("attacking"),
        F.coalesce("regen", F.lit(0.0)).alias("regen"),
        F.coalesce("effects", F.array().cast("array<bigint>")).alias("effects"),
    )
    looked_up = _state_rows(status, F.col("doc.planetStatus"), first=True)
    plain = _plain_contests(status, F.col("doc.campaigns"), nameless, looked_up, classify=False)
    events = _event_contests(status, F.col("doc"), nameless, states, use_state=False)
    first = shaping.first_item(F.col("doc.majorOrders"))
    orders = live.select(POLL, first.alias("a")).where(F.col("a").isNotNull())
    assignments = orders.select(
        POLL,
        F.col("a.id32").alias("id"),
        precedence.override(F.col("a.setting.overrideBrief"), default="").alias("briefing"),
        precedence.override(F.col("a.setting.overrideTitle"), default=fixed.ASSIGNMENT_TITLE).alias(
            "title"
        ),
        _tasks(F.col("a.setting.tasks")).alias("tasks"),
        F.coalesce("a.progress", F.array().cast("array<bigint>")).alias("progress"),
        F.lit("").alias("expiration"),
        F.lit("").alias("deadline"),
    )
    war = status.select(
        POLL,
        F.coalesce("doc.time", F.lit(0)).alias("time"),
        F.coalesce("doc.statistics.playerCount", F.lit(0)).alias("players"),
        *_no_missions(),
        F.lit(None).cast("string").alias("started"),
        F.lit(None).cast("string").alias("ended"),
    )
    return Source(
        polls=docs.polls_of(live),
        entities=entities,
        contests=plain.unionByName(events),
        assignments=assignments,
        bulletins=_bulletins(docs.items(live, F.col("doc.news"))),
        war=war,
        stations=_stations(live, F.col("doc.spaceStations")),
    ).complete(work)


# ---- the REST source ----


def read_rest(
    spark: SparkSession, landing: str, work: str | None = None, since: int | None = None
) -> Source:
    """The rest source's polls from ``since`` on; ``work`` is a folder in the shared storage."""
    work = f"{work or run_folder(spark, 'status')}/rest"
    staged = docs.stage(
        spark, landing, REST_DOCUMENTS, f"{work}/documents", since, REST_NULLABLE, REST_EXTRAS)
    war, planets, campaigns, assignment, dispatches = (staged[name] for name in REST_DOCUMENTS)

    rows = docs.items_with_extra(planets).select(
        POLL,
        F.col("item.index").alias("entity_id"),
        "seq",
        F.col("item.name").alias("name"),
        F.col("item.sector").alias("sector"),
        F.col("item.currentOwner").alias("owner"),
        F.col("item.health").alias("health"),
        F.col("item.maxHealth").alias("max_health"),
        F.col("item.players").alias("players"),
        normalize.variant_truthy(F.col("item.attacking")).alias("attacking"),
        F.col("item.regenPerSecond").alias("regen"),
        F.coalesce("item.activeEffects", F.array().cast("array<bigint>")).alias("effects"),
        F.col("item.statistics").alias("totals"),
        F.col("extra.own").alias("extra"),
    )
    rows = history.last_per_key(
        rows.where(F.col("entity_id").isNotNull()), KEYS, [F.col("seq")]
    ).drop("seq")
    entities = rows.drop("totals")
    statistics = rows.select(*KEYS, "totals").where(F.col("totals").isNotNull())
    contests = docs.items_with_extra(campaigns).select(
        POLL,
        "seq",
        F.col("item.id").alias("contest_id"),
        F.col("item.faction").alias("faction"),
        normalize.variant_text(F.col("item.type")).alias("type"),
        _integer_text(F.col("item.type")).alias("type_code"),
        F.col("item.eventType").alias("event_kind"),
        F.col("item.campaignType").alias("contest_class"),
        *[
            (F.col("item.defendersProgress") if c == "defenders_progress" else F.lit(None))
            .cast(t)
            .alias(c)
            for c, t in _PROGRESS.items()
        ],
        F.col("item.count").alias("count"),
        F.col("item.planet.index").alias("entity_id"),
        F.col("item.planet.name").alias("name"),
        F.col("item.planet.sector").alias("sector"),
        F.col("item.planet.currentOwner").alias("owner"),
        F.col("extra.own").alias("extra"),
        F.col("extra.planet").alias("place_extra"),
    )
    first = assignment.select(POLL, shaping.first_item(F.col("doc")).alias("a")).where(
        F.col("a").isNotNull()
    )
    assignments = first.select(
        POLL,
        F.col("a.id").alias("id"),
        precedence.override(F.col("a.briefing"), default="").alias("briefing"),
        precedence.override(F.col("a.title"), default=fixed.ASSIGNMENT_TITLE).alias("title"),
        _tasks(F.col("a.tasks")).alias("tasks"),
        F.coalesce("a.progress", F.array().cast("array<bigint>")).alias("progress"),
        normalize.iso_variant(F.col("a.expiration")).alias("expiration"),
        F.coalesce(normalize.variant_text(F.col("a.expiration")), F.lit("")).alias("deadline"),
    )
    return Source(
        polls=docs.polls_of(war, planets, campaigns, assignment, dispatches),
        entities=entities,
        contests=contests,
        assignments=assignments,
        bulletins=_bulletins(docs.items_with_extra(dispatches), F.col("extra.own")),
        war=war.select(
            POLL,
            F.lit(0).cast("bigint").alias("time"),
            F.coalesce("doc.statistics.playerCount", F.lit(0)).alias("players"),
            F.coalesce("doc.statistics.missionsWon", F.lit(0)).alias("missions_won"),
            F.coalesce("doc.statistics.missionsLost", F.lit(0)).alias("missions_lost"),
            F.col("doc.started").alias("started"),
            F.col("doc.ended").alias("ended"),
            F.col("extra.own").alias("extra"),
            F.col("extra.statistics").alias("statistics_extra"),
        ),
        statistics=statistics,
    ).complete(work)


# ---- the time series ----


def read_series(spark: SparkSession, landing: str, since: int | None = None) -> DataFrame:
    """The newest record of each poll's series document, with the players per faction."""
    series = docs.read_documents(spark, f"{landing}/series", docs.SERIES, since)
    latest = series.select(
        POLL, F.get("doc.data", F.size("doc.data") - 1).alias("r")
    ).where(F.col("r").isNotNull())
    wide = latest.select(
        POLL,
        F.coalesce("r.timestampUtc", F.lit("")).alias("timestamp"),
        F.coalesce("r.totalPlayerCount", F.lit(0)).alias("total_players"),
        F.coalesce("r.playerCountHumans", F.lit(0)).alias("Humans"),
        F.coalesce("r.playerCountTerminids", F.lit(0)).alias("Terminids"),
        F.coalesce("r.playerCountAutomatons", F.lit(0)).alias("Automatons"),
        F.coalesce("r.playerCountIlluminate", F.lit(0)).alias("Illuminate"),
        F.coalesce("r.impactMultiplier", F.lit(0.0)).alias("impact_multiplier"),
    )
    return shaping.nest(
        wide,
        [POLL],
        "factions",
        ["Humans", "Terminids", "Automatons", "Illuminate"],
        timestamp="timestamp",
        total_players="total_players",
        impact_multiplier="impact_multiplier",
    )


def series_history(series: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The bounded history after adding every poll's record whose timestamp is new."""
    incoming = history.first_per_key(series, ["timestamp"], [F.col(POLL)]).drop(POLL)
    kept = incoming if store is None else history.append_if_absent(store, incoming, ["timestamp"])
    return history.retention_tail(kept, [F.desc("timestamp")])


# ---- shared row shapes ----

_PROGRESS = {
    "attackers_progress": "double",
    "defenders_progress": "double",
    "attackers_rate": "double",
    "start_time": "bigint",
    "remaining_time": "bigint",
    "level": "int",
}


def _no_missions():
    """Only the REST source counts missions."""
    return [F.lit(0).cast("bigint").alias(c) for c in ("missions_won", "missions_lost")]


def _integer_text(value):
    """A variant's text where it is an integer."""
    return F.when(F.schema_of_variant(value) == "BIGINT", normalize.variant_text(value))


def _tasks(*candidates):
    """The first present task list as JSON text."""
    found = [F.when(normalize.variant_truthy(c), F.to_json(c)) for c in candidates]
    return F.coalesce(*found, F.lit("[]"))


def _info_rows(info: DataFrame) -> DataFrame:
    rows = docs.items(info, F.col("doc.planetInfos")).select(
        POLL,
        F.col("item.index").alias("entity_id"),
        "seq",
        F.col("item.name").alias("name"),
        normalize.decode_variant(
            F.col("item.sector"), fixed.SECTOR_CODES, "", decode_text=False
        ).alias("sector"),
    )
    return history.last_per_key(
        rows.where(F.col("entity_id").isNotNull()), KEYS, [F.col("seq")]
    ).drop("seq")


def _state_rows(status: DataFrame, path, first: bool = False) -> DataFrame:
    """Status rows, one per entity: the last of an entity's rows, or the first."""
    rows = docs.items(status, path).select(
        POLL,
        F.col("item.index").alias("entity_id"),
        "seq",
        normalize.decode_variant(F.col("item.owner"), fixed.OWNER_CODES, fixed.UNKNOWN).alias(
            "owner"
        ),
        F.col("item.health").alias("health"),
        F.col("item.maxHealth").alias("max_health"),
        F.col("item.players").alias("players"),
        normalize.variant_truthy(F.col("item.attacking")).alias("attacking"),
        F.col("item.regenPerSecond").alias("regen"),
    )
    pick = history.first_per_key if first else history.last_per_key
    return pick(rows.where(F.col("entity_id").isNotNull()), KEYS, [F.col("seq")]).drop("seq")


def _effect_rows(status: DataFrame, path, entity_id) -> DataFrame:
    rows = docs.items(status, path).select(
        POLL,
        entity_id.alias("entity_id"),
        "seq",
        F.col("item.galacticEffectId").alias("effect"),
    )
    return shaping.distinct_in_order(
        rows.where(F.col("entity_id").isNotNull()), KEYS, "effect", F.col("seq")
    )


def _faction(code):
    """Label of a contest's code, else the entity's owner."""
    own = normalize.decode_variant(code, fixed.OWNER_CODES, fixed.UNKNOWN)
    return F.when(normalize.variant_truthy(code), own).otherwise(
        F.coalesce("s_owner", F.lit(fixed.UNKNOWN))
    )


def _with_info(contests: DataFrame, infos: DataFrame, states: DataFrame) -> DataFrame:
    return overlay.attach(overlay.attach(contests, infos, KEYS, "i_"), states, KEYS, "s_")


def _contest_columns(**values):
    columns = {
        "contest_id": "bigint", "faction": "string", "type": "string", "type_code": "string",
        "event_kind": "bigint", "contest_class": "string", **_PROGRESS, "count": "bigint",
    }
    return [
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()
    ] + [
        falsy.first_text(F.col("i_name"), normalize.synthetic_name(F.col("entity_id"))).alias("name"),
        F.coalesce("i_sector", F.lit("")).alias("sector"),
        values.get("owner", F.coalesce("s_owner", F.lit(fixed.UNKNOWN))).alias("owner"),
    ]


def _plain_contests(status, path, infos, states, classify: bool) -> DataFrame:
    rows = docs.items(status, path).select(
        POLL, F.col("item.planetIndex").alias("entity_id"), "seq", "item"
    )
    kind = F.coalesce(normalize.variant_text(F.col("item.type")), F.lit("0"))
    code = F.col("item.faction") if classify else F.col("item.race")
    count = F.col("item.campaignId") if classify else F.col("item.count")
    return _with_info(rows, infos, states).select(
        *KEYS,
        "seq",
        *_contest_columns(
            contest_id=F.col("item.id"),
            faction=_faction(code),
            type=kind,
            type_code=_integer_text(F.col("item.type")),
            contest_class=metrics.contest_class(kind) if classify else F.lit(None),
            count=count,
        ),
    )


def _event_contests(status, root, infos, states, use_state: bool) -> DataFrame:
    rows = docs.items(status, root["planetEvents"], root["time"].alias("now")).select(
        POLL, F.col("item.planetIndex").alias("entity_id"), "seq", "item", "now"
    )
    joined = _with_info(rows, infos, states)
    if use_state:
        maximum = falsy.first_number(F.col("item.maxHealth"), F.col("s_max_health"), F.lit(0))
        current = falsy.first_number(F.col("item.health"), F.col("s_health"), F.lit(0))
    else:
        maximum = F.coalesce("item.maxHealth", F.lit(0))
        current = F.coalesce("item.health", F.lit(0))
    joined = joined.select(
        "*",
        F.coalesce(maximum, F.lit(0)).alias("maximum"),
        F.coalesce(current, F.lit(0)).alias("current"),
        F.coalesce("item.startTime", F.lit(0)).alias("start"),
        F.coalesce("item.expireTime", F.lit(0)).alias("end"),
    ).withColumn("rate", metrics.attacker_rate(F.col("start"), F.col("end")))
    race = F.col("item.race")
    either = F.coalesce(race, F.col("item.faction")) if use_state else race
    owner = F.coalesce("s_owner", F.lit(fixed.UNKNOWN)) if use_state else F.lit("Humans")
    return joined.select(
        *KEYS,
        # Events come after the plain contests of the same document.
        (F.col("seq") + F.lit(1 << 40)).alias("seq"),
        *_contest_columns(
            contest_id=falsy.first_number(F.col("item.id"), F.col("item.eventId")),
            faction=normalize.decode_variant(either, fixed.OWNER_CODES, fixed.UNKNOWN),
            type=F.lit(fixed.DEFENSE),
            event_kind=F.coalesce("item.eventType", F.lit(1)),
            contest_class=F.lit(fixed.DEFENSE),
            attackers_progress=metrics.attacker_progress(
                F.col("rate"), F.col("start"), F.col("now")
            ),
            defenders_progress=metrics.defender_progress(F.col("current"), F.col("maximum")),
            attackers_rate=F.col("rate"),
            start_time=F.col("start"),
            remaining_time=metrics.remaining(F.col("end"), F.col("now")),
            level=metrics.level(F.col("maximum")),
            count=F.lit(0),
            owner=owner,
        ),
    )


def _dedupe(contests: DataFrame) -> DataFrame:
    rank = F.when(F.col("event_kind").isNotNull(), 0).when(
        F.col("type") == fixed.DEFENSE, 1
    ).otherwise(2)
    known = contests.where(F.col("entity_id").isNotNull())
    return history.first_per_key(known, KEYS, [rank, F.col("seq")])


def _bulletins(items: DataFrame, extra=None, in_order: bool = False) -> DataFrame:
    """The newest bulletins by id, in that order or (``in_order``) in that of the document."""
    rows = items.select(
        POLL,
        F.col("item.id").alias("id"),
        normalize.iso_variant(F.col("item.published")).alias("published"),
        normalize.variant_text(F.col("item.type")).alias("type"),
        F.col("item.message").alias("message"),
        "seq",
        *([] if extra is None else [extra.alias("extra")]),
    )
    newest_first = [F.desc(F.coalesce("id", F.lit(0))), F.col("seq")]
    newest = history.newest_per_key(rows, [POLL], newest_first, fixed.BULLETINS_KEPT)
    place = F.col("seq") if in_order else -F.coalesce("id", F.lit(0))
    return newest.withColumn("seq", place.cast("bigint"))


def _stations(documents: DataFrame, path) -> DataFrame:
    first = documents.select(POLL, shaping.first_item(path).alias("s")).where(
        F.col("s").isNotNull()
    )
    return first.select(
        POLL,
        F.col("s.planetIndex").alias("entity_id"),
        F.coalesce("s.activeEffectIds", F.array().cast("array<bigint>")).alias("effects"),
        normalize.iso_variant(F.col("s.currentElectionEndWarTime")).alias("election_end"),
    )
