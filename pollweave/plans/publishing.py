"""Write a status: its tables as rows, and a JSON document per poll, in parts.

A document is a sequence of fragments: its head, for every list an opening, one fragment per
row and a closing, the single records, its end. Fragments are numbered along the poll, which
is range-partitioned like any long key, and every PART of them in a row become one line of
text. So a poll of any size is written by many tasks, and none holds it whole. A document of
one part is one line; the lines of a longer one, in the order of its files, are its text with
line ends between fragments, where JSON allows them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pollweave.functions import fixed, normalize
from pollweave.operators import ordered
from pollweave.operators.precedence import SOURCE
from pollweave.plans.status import Status
from pollweave.session import written
from pollweave.sources.documents import POLL, joined

# Fragments of a part.
PART = 4096
_FACTIONS = ["Humans", "Terminids", "Automatons", "Illuminate"]
_OPEN, _ITEM, _CLOSE = 0, 1, 2


def _json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _field(name: str, value: Column) -> Column:
    """An object of one field, whose value is JSON text or, if that is null, null."""
    return F.concat(F.lit(f'{{"{name}":'), F.coalesce(value, F.lit("null")), F.lit("}"))


def _entities(status: Status) -> DataFrame:
    row = _json(
        F.col("entity_id").alias("index"),
        "name",
        "sector",
        F.col("owner").alias("currentOwner"),
        "health",
        F.col("max_health").alias("maxHealth"),
        "players",
        "attacking",
        "resistance",
        F.col("effects").alias("activeEffects"),
    )
    return status.entities.select(
        POLL, F.col("entity_id").alias("first"), joined(row, F.col("extra")).alias("text"))


def _contests(status: Status) -> DataFrame:
    row = _json(
        F.col("contest_id").alias("id"),
        "faction",
        "type",
        F.col("event_kind").alias("eventType"),
        F.col("contest_class").alias("campaignType"),
        F.col("attackers_progress").alias("attackersProgress"),
        F.col("defenders_progress").alias("defendersProgress"),
        F.col("attackers_rate").alias("attackersRate"),
        F.col("defenders_rate").alias("defendersRate"),
        F.col("start_time").alias("startTime"),
        F.col("remaining_time").alias("remainingTime"),
        F.col("level").alias("invasionLevel"),
        "count",
    )
    place = _json(
        F.col("entity_id").alias("index"), "name", "sector", F.col("owner").alias("currentOwner"))
    placed = joined(row, _field("planet", joined(place, F.col("place_extra"))))
    return status.contests.select(
        POLL, F.col("seq").alias("first"), joined(placed, F.col("extra")).alias("text"))


def _bulletins(status: Status) -> DataFrame:
    row = _json("id", "published", "type", "message")
    return status.bulletins.select(
        POLL, F.col("seq").alias("first"), joined(row, F.col("extra")).alias("text"))


def _recon(status: Status) -> DataFrame:
    """Entries of a map by entity; they stand in the order of their text."""
    row = _json(
        F.lit(None).cast("double").alias("healthImpact"),
        F.col("success_per_hour").alias("successPerHour"),
        F.col("fail_per_hour").alias("failPerHour"),
        F.col("enemies_per_hour").alias("enemiesPerHour"),
        F.col("deaths_per_hour").alias("deathsPerHour"),
        F.col("success_rate").alias("successRate"),
        F.col("fail_rate").alias("failRate"),
    )
    entry = F.concat(F.lit('"'), F.col("entity_id").cast("string"), F.lit('":'), row)
    return status.recon.select(POLL, F.lit(0).cast("bigint").alias("first"), entry.alias("text"))


def _war(status: Status) -> DataFrame:
    statistics = _json(
        F.col("players").alias("playerCount"),
        F.col("missions_won").alias("missionsWon"),
        F.col("missions_lost").alias("missionsLost"),
    )
    counted = _field("statistics", joined(statistics, F.col("statistics_extra")))
    row = joined(joined(_json("time"), counted), _json("started", "ended"))
    return status.war.select(POLL, joined(row, F.col("extra")).alias("war"))


def _single_records(status: Status) -> dict[str, DataFrame]:
    """Per name the table (poll_ts, JSON text) of a record that a poll has once at most."""
    assignment = _json(
        "id", "briefing", "title", F.parse_json("tasks").alias("tasks"), "progress", "expiration",
        "deadline", F.col("server_time").alias("serverTime"))
    station = _json(
        F.col("entity_id").alias("planetIndex"), F.col("effects").alias("activeEffectIds"),
        F.col("election_end").alias("electionEnd"))
    return {
        "war": _war(status),
        "assignments": status.assignments.select(POLL, assignment.alias("assignments")),
        "dss": status.stations.select(POLL, station.alias("dss")),
    }


def _series_records(series: DataFrame) -> DataFrame:
    record = _json(
        F.col("total_players").alias("total"),
        *[F.col(f"factions.{c}").alias(c.lower()) for c in _FACTIONS],
        F.col("timestamp").alias("updatedAt"),
    )
    return series.select(
        POLL, record.alias("player_distribution"),
        F.col("impact_multiplier").cast("string").alias("impactMultiplier"))


def fragments(
    status: Status, series: DataFrame | None = None, owned: DataFrame | None = None
) -> DataFrame:
    """The pieces of all documents: poll_ts, place, kind, first, text.

    The rows of the lists are written, so that their tables are worked out once for the pieces,
    their counts and the sample of a range partitioning.
    A document's pieces in the order of (place, kind, first, text) are its text, but for what
    joins the rows of a list.
    """
    lists = {
        "planets": (_entities(status), "[]"),
        "campaigns": (_contests(status), "[]"),
        "dispatches": (_bulletins(status), "[]"),
        "recon_stats": (_recon(status), "{}"),
    }
    records = _single_records(status)
    if series is not None:
        both = _series_records(series)
        records["player_distribution"] = both.select(POLL, "player_distribution")
        records["impactMultiplier"] = both.select(POLL, "impactMultiplier")
    if owned is not None:
        for name in ("news", "major_order"):
            records[name] = owned.select(POLL, F.to_json(name, _KEEP_NULLS).alias(name))
    head = _json(_fetched_at().alias("fetchedAt"), SOURCE)
    polls = status.polls.select(POLL, F.substring(head, F.lit(1), F.length(head) - 1).alias("head"))
    for rows in records.values():
        polls = polls.join(rows, POLL, "left")

    order = [n for n in ORDER if n in lists or n in records]
    places = {name: place for place, name in enumerate(order, 1)}
    items = written(reduce(DataFrame.unionByName, [
        rows.select(
            POLL, F.lit(places[name]).alias("place"), F.lit(_ITEM).alias("kind"), "first", "text")
        for name, (rows, _) in lists.items()
    ]), "items")
    counts = items.groupBy(POLL).agg(
        *[F.count_if(F.col("place") == places[name]).alias(name) for name in lists])
    polls = polls.join(counts, POLL, "left")
    pieces = [_piece(0, _OPEN, F.col("head")), _piece(len(order) + 1, _OPEN, F.lit("}"))]
    for name, place in places.items():
        begin = F.lit(f',"{name}":')
        if name in records:
            value = F.coalesce(F.col(name), F.lit("null"))
            pieces.append(_piece(place, _OPEN, F.concat(begin, value)))
            continue
        ends = lists[name][1]
        filled = F.coalesce(F.col(name), F.lit(0)) > 0
        pieces += [
            _piece(place, _OPEN, F.concat(begin, F.when(filled, ends[0]).otherwise("null"))),
            _piece(place, _CLOSE, F.when(filled, ends[1]).otherwise("")),
        ]
    single = polls.select(POLL, F.explode(F.array(*pieces)).alias("piece")).select(POLL, "piece.*")
    return single.unionByName(items)


# The fields of a document in their order.
ORDER = [
    "war", "planets", "campaigns", "dispatches", "assignments", "dss", "recon_stats",
    "player_distribution", "impactMultiplier", "news", "major_order",
]
_KEEP_NULLS = {"ignoreNullFields": "false"}


def _piece(place: int, kind: int, text: Column) -> Column:
    return F.struct(
        F.lit(place).alias("place"), F.lit(kind).alias("kind"),
        F.lit(None).cast("bigint").alias("first"), text.alias("text"))


def document_parts(
    status: Status,
    series: DataFrame | None = None,
    owned: DataFrame | None = None,
    part: int = PART,
) -> DataFrame:
    """The documents of all polls in parts: ``(poll_ts, part, text)``.

    ``owned`` is the previous output of another writer as ``(poll_ts, news,
    major_order)``; its columns are kept.
    """
    placed = ordered.numbered(
        fragments(status, series, owned), [POLL], ["place", "kind", "first", "text"], "number",
        "kind")
    # A list's first row comes right behind its opening.
    comma = (F.col("kind") == _ITEM) & (F.col("prev_kind") == _ITEM)
    text = F.concat(F.when(comma, ",").otherwise(""), "text")
    lines = F.array_sort(F.collect_list(F.struct("number", text.alias("text"))))
    return placed.groupBy(POLL, F.floor(F.col("number") / part).alias("part")).agg(
        F.array_join(F.transform(lines, lambda x: x["text"]), "").alias("text"))


def poll_documents(
    status: Status, series: DataFrame | None = None, owned: DataFrame | None = None
) -> DataFrame:
    """One JSON document per poll, ``(poll_ts, document)``, where polls are known to be small."""
    parts = document_parts(status, series, owned)
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(POLL).agg(
        F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("document"))


def _fetched_at() -> Column:
    hours = fixed.LOCAL_OFFSET_HOURS
    return normalize.iso_seconds(F.col(POLL) + hours * 3600, f"+{hours:02d}:00")


def publish(
    status: Status,
    folder: str,
    series: DataFrame | None = None,
    owned: DataFrame | None = None,
) -> None:
    """Write all tables of the status as rows, one folder each, polls replaced one by one.

    ``polls`` has the source and the time of each poll; ``series`` and ``owned`` are
    written where they are given. Fields that only one source knows come as objects of
    their own. The format does not depend on the size of a poll.
    """
    tables = {name: getattr(status, name) for name in status.TABLES}
    tables["polls"] = status.polls.select(POLL, SOURCE, _fetched_at().alias("fetched_at"))
    if series is not None:
        tables["series"] = series
    if owned is not None:
        tables["owned"] = owned
    tables["entities"] = tables["entities"].drop("good_max")  # for the next run only
    for name, rows in tables.items():
        for column in ("extra", "place_extra", "statistics_extra"):
            if column in rows.columns:
                rows = rows.withColumn(column, F.parse_json(column))
        # The rows of a poll are brought together first, so that not every task writes a
        # file for every poll; adaptive execution splits a large one.
        _by_poll(rows.hint("rebalance", POLL)).json(f"{folder}/{name}")


def publish_documents(
    status: Status,
    folder: str,
    series: DataFrame | None = None,
    owned: DataFrame | None = None,
    part: int = PART,
) -> None:
    """Write a document per poll as well; the parts of a large one are written side by side.

    The lines of a poll's folder, file by file in the order of their names, are its document.
    """
    parts = document_parts(status, series, owned, part)
    cut = parts.repartitionByRange(POLL, "part").sortWithinPartitions(POLL, "part")
    _by_poll(cut.select(POLL, "text")).text(f"{folder}/documents")


def _by_poll(rows: DataFrame):
    """A writer that replaces the polls it writes and leaves the others."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy(POLL)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The written documents, ``(poll_ts, document)``, where polls are known to be small."""
    files = spark.read.schema(f"value string, {POLL} bigint").text(
        f"{folder}/documents", wholetext=True)
    texts = F.array_sort(F.collect_list(F.struct(F.col("_metadata.file_name").alias("file"), "value")))
    return files.groupBy(POLL).agg(
        F.array_join(F.transform(texts, lambda x: x["value"]), "").alias("document"))
