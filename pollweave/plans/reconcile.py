"""Settle the sources of all polls into one status (``publishing`` writes it).

Every step is one join, aggregate or window over all polls at once. State of
earlier runs enters as the rows of older polls.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pollweave.functions import falsy, fixed, metrics, normalize
from pollweave.operators import history, ordered, overlay, precedence
from pollweave.operators.precedence import SOURCE
from pollweave.plans.status import AGGREGATE, KEYS, PRIMARY, REST, Source, Status
from pollweave.sources import state
from pollweave.sources.documents import POLL

_EFFECTS = "array<bigint>"


class NoSource(RuntimeError):
    """No source delivered a complete poll."""


@dataclass
class Carried:
    """What later polls may need from earlier runs, one row per key."""

    entities: DataFrame  # poll_ts, entity_id, good_max, seen_effects
    contests: DataFrame  # poll_ts, entity_id, defenders_progress
    assignments: DataFrame
    stations: DataFrame
    polls: DataFrame


def reconcile(
    primary: Source, aggregate: Source, rest: Source, carried: Carried | None = None
) -> Status:
    """One status per poll that at least one source delivered."""
    sources = {PRIMARY: primary, AGGREGATE: aggregate, REST: rest}
    polls = precedence.whole_poll(
        precedence.stack({label: s.polls for label, s in sources.items()}), [POLL]
    ).drop("source_rank")
    if polls.isEmpty():
        raise NoSource("every source failed for every poll")

    contests = functools.cache(lambda: _with_recon(_contests(sources, polls, carried), rest))
    return Status(
        polls=polls,
        entities=lambda: _entities(sources, polls, carried),
        contests=lambda: contests()[0],
        recon=lambda: contests()[1],
        assignments=lambda: _assignments(sources, polls, carried),
        bulletins=lambda: _bulletins(sources, polls),
        war=lambda: _war(sources, polls),
        stations=lambda: _carry(
            polls,
            _first_source({PRIMARY: primary.stations, AGGREGATE: aggregate.stations}),
            carried and carried.stations,
        ),
    )


def _base(sources: dict[str, Source], table: str, polls: DataFrame) -> DataFrame:
    """A table's rows of the source chosen for each poll."""
    stacked = precedence.stack({label: getattr(s, table) for label, s in sources.items()})
    return stacked.join(polls, [POLL, SOURCE], "left_semi").drop("source_rank")


def _first_source(tables: dict[str, DataFrame]) -> DataFrame:
    return precedence.whole_poll(precedence.stack(tables), [POLL]).drop("source_rank")


def _entities(sources, polls, carried) -> DataFrame:
    base = _base(sources, "entities", polls)
    live = overlay.overlay(
        base,
        sources[AGGREGATE].entities,
        KEYS,
        {
            "players": overlay.take_number,
            "effects": overlay.take_array,
            "regen": overlay.take_or_zero,
        },
    )
    named = overlay.overlay(
        live,
        sources[REST].entities,
        KEYS,
        {
            "name": overlay.take_if_stand_in,
            "sector": overlay.take_always,
            "max_health": overlay.take_below(),
        },
    )
    maximum = F.col("max_health")
    rows = named.withColumns(
        {
            "good_max": F.when(maximum >= fixed.ABSOLUTE_MAX_FLOOR, maximum),
            "seen_effects": falsy.array(F.col("effects")),
            "_new": F.lit(True),
        }
    )
    if carried is not None:
        rows = rows.unionByName(carried.entities.withColumn("_new", F.lit(False)), True)
    known = ordered.last_known(rows, ["entity_id"], [POLL], ["good_max", "seen_effects"])
    fresh = overlay.attach(
        known.where("_new"),
        sources[AGGREGATE].entities.select(POLL).distinct(),
        [POLL],
        "live_",
    )
    settled = overlay.best_maximum(
        F.coalesce(maximum, F.lit(0)), F.col("last_good_max"), F.col("health")
    )
    kept = F.when(
        F.col("live__matched").isNull(), F.coalesce("seen_effects", "last_seen_effects")
    ).otherwise(F.col("seen_effects"))
    return (
        fresh.withColumn("max_health", settled)
        .withColumn("effects", F.coalesce(kept, F.array().cast(_EFFECTS)))
        .withColumn("resistance", metrics.regen_percent(F.col("regen"), F.col("max_health")))
        .select(
            *KEYS, SOURCE, "name", "sector", "owner", "health", "max_health", "players",
            "attacking", "resistance", "effects", "extra",
            F.col("last_good_max").alias("good_max"),
        )
    )


def _contests(sources, polls, carried) -> DataFrame:
    contests = overlay.overlay(
        _base(sources, "contests", polls),
        sources[REST].entities,
        KEYS,
        {"name": overlay.take_if_stand_in, "sector": overlay.take_always},
    )
    before = history.last_per_key(
        contests.where(F.col("entity_id").isNotNull()).select(*KEYS, "defenders_progress", "seq"),
        KEYS,
        [F.col("seq")],
    ).drop("seq")
    all_polls = polls.select(POLL)
    if carried is not None:
        before = before.unionByName(carried.contests)
        all_polls = all_polls.unionByName(carried.polls)
    sequence = ordered.previous_values(
        all_polls.withColumn("_series", F.lit(0)), ["_series"], [POLL], [POLL]
    ).drop("_series")
    before = before.select(
        F.col(POLL).alias(f"prev_{POLL}"),
        "entity_id",
        F.col("defenders_progress").alias("_before"),
    )
    joined = contests.join(sequence, POLL, "left").join(
        before, [f"prev_{POLL}", "entity_id"], "left"
    )
    defended = (F.col("type") == fixed.DEFENSE) | (F.col("event_kind") == 1)
    rate = metrics.delta_per_hour(
        F.col("defenders_progress"),
        F.col("_before"),
        (F.col(POLL) - F.col(f"prev_{POLL}")) / 3600,
    )
    return joined.withColumn("defenders_rate", F.when(defended, rate)).drop(
        f"prev_{POLL}", "_before"
    )


def _with_recon(contests: DataFrame, rest: Source) -> tuple[DataFrame, DataFrame]:
    kind = metrics.with_recon(
        F.col("type_code"), F.col("event_kind"), F.col("entity_id"), F.col("contest_class")
    )
    contests = contests.withColumn("contest_class", kind).drop("type_code")
    surveyed = contests.where(F.col("contest_class") == fixed.RECON).select(*KEYS).distinct()
    totals = F.col("totals")
    ratios = metrics.ratio_columns(
        totals["missionsWon"],
        totals["missionsLost"],
        totals["missionTime"],
        [totals["terminidKills"], totals["automatonKills"], totals["illuminateKills"]],
        falsy.first_number(totals["deaths"], totals["helldiversDeaths"]),
    )
    recon = surveyed.join(rest.statistics, KEYS, "left").select(
        *KEYS, *[column.alias(name) for name, column in ratios.items()]
    )
    return contests, recon


def _assignments(sources, polls, carried) -> DataFrame:
    chosen = _first_source(
        {label: sources[label].assignments for label in (AGGREGATE, PRIMARY, REST)}
    )
    deadlines = sources[REST].assignments.where(falsy.text(F.col("deadline")).isNotNull())
    dated = overlay.overlay(
        chosen, deadlines.select(POLL, "deadline"), [POLL], {"deadline": overlay.take_always}
    )
    served = F.when(falsy.text(F.col("deadline")).isNotNull(), normalize.iso_seconds(F.col(POLL)))
    dated = dated.withColumn("server_time", F.coalesce(served, F.lit("")))
    return _carry(polls, dated, carried and carried.assignments)


def _bulletins(sources, polls) -> DataFrame:
    blanked = sources[AGGREGATE].bulletins.withColumn("published", F.lit(""))
    chosen = _first_source({
        REST: sources[REST].bulletins, AGGREGATE: blanked, PRIMARY: sources[PRIMARY].bulletins})
    return chosen.join(polls.select(POLL), POLL, "left_semi").drop(SOURCE)


def _war(sources, polls) -> DataFrame:
    totals = sources[AGGREGATE].entities.groupBy(POLL).agg(F.sum("players").alias("summed"))
    seen = sources[AGGREGATE].polls.join(totals, POLL, "left")
    war = overlay.attach(_base(sources, "war", polls), seen, [POLL], "live_")
    war = overlay.attach(war, sources[REST].war.select(POLL, "players"), [POLL], "rest_")
    players = overlay.sum_or(
        F.col("live_summed"), F.col("live__matched").isNotNull(), F.col("rest_players")
    )
    return war.select(
        POLL, SOURCE, "time", players.alias("players"), "missions_won", "missions_lost", "started",
        "ended", "extra", "statistics_extra",
    )


def _carry(polls: DataFrame, rows: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """A singleton record per poll, from the newest earlier poll where none arrived."""
    record = [c for c in rows.columns if c != POLL]
    packed = polls.select(POLL).join(
        rows.select(POLL, F.struct(*record).alias("record")), POLL, "left"
    )
    packed = packed.withColumn("_new", F.lit(True))
    if earlier is not None:
        old = earlier.select(
            POLL, F.struct(*record).alias("record"), F.lit(False).alias("_new")
        )
        packed = packed.unionByName(old)
    filled = history.carry_forward(
        packed.withColumn("_series", F.lit(0)), ["_series"], [POLL], ["record"]
    )
    return filled.where(F.col("_new") & F.col("record").isNotNull()).select(POLL, "record.*")


# ---- state between runs ----

_CARRIED = {
    "entities": f"{POLL} bigint, entity_id bigint, good_max bigint, seen_effects {_EFFECTS}",
    "contests": f"{POLL} bigint, entity_id bigint, defenders_progress double",
    "assignments": f"""{POLL} bigint, id bigint, briefing string, title string, tasks string,
        progress array<bigint>, expiration string, deadline string, server_time string,
        source string""",
    "stations": f"{POLL} bigint, entity_id bigint, effects {_EFFECTS}, election_end string, source string",
    "polls": f"{POLL} bigint",
}


def carry_over(status: Status, earlier: Carried | None = None) -> Carried:
    """Reduce a status to what later polls need: one row per entity and per record.

    The maximum that is carried is one that a source sent, not a health that stood in for it.
    """
    entities = status.entities.select(
        *KEYS, "good_max", falsy.array(F.col("effects")).alias("seen_effects"))
    polls = status.polls.select(POLL)
    assignments = status.assignments
    stations = status.stations
    if earlier is not None:
        entities = entities.unionByName(earlier.entities)
        assignments = assignments.unionByName(earlier.assignments)
        stations = stations.unionByName(earlier.stations)
    newest = polls.agg(F.max(POLL).alias(POLL))
    contests = status.contests.where(F.col("entity_id").isNotNull()).join(newest, POLL, "left_semi")
    known = entities.groupBy("entity_id").agg(
        F.max(POLL).alias(POLL),
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(POLL))).alias(c)
            for c in ("good_max", "seen_effects")
        ],
    )
    return Carried(
        entities=known.select(POLL, "entity_id", "good_max", "seen_effects"),
        contests=history.last_per_key(
            contests.select(*KEYS, "defenders_progress", "seq"), KEYS, [F.col("seq")]
        ).drop("seq"),
        assignments=history.newest(assignments, [F.desc(POLL)], 1),
        stations=history.newest(stations, [F.desc(POLL)], 1),
        polls=newest,
    )


def save_carried(carried: Carried, folder: str, version: int) -> None:
    for name in _CARRIED:
        state.save(getattr(carried, name), f"{folder}/{name}", version)


def load_carried(spark: SparkSession, folder: str, version: int) -> Carried:
    """The newest state older than ``version``; empty tables on the first run."""
    return Carried(
        **{
            name: state.load_before(spark, f"{folder}/{name}", ddl, version)
            for name, ddl in _CARRIED.items()
        }
    )
