"""Typed scans of the JSON documents in the landing zone.

A poll leaves each document it fetched under ``<landing>/<document>/poll_ts=<epoch
seconds>/``. A landing of many polls may keep a kind of document as a table instead
(``archive``), or both. Every reader returns rows with ``poll_ts``; a document that is not
valid JSON of its type gives no row, a document that never arrived an empty table.
Fields whose JSON type varies from poll to poll are read as variants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pollweave.sources import health

POLL = "poll_ts"

# The documents' folders and field names.
STATUS = """struct<
  time: bigint,
  planetStatus: array<struct<index: bigint, owner: variant, health: bigint, maxHealth: bigint,
    players: bigint, regenPerSecond: double, attacking: variant>>,
  planetActiveEffects: array<struct<index: bigint, planetIndex: bigint, galacticEffectId: bigint>>,
  campaigns: array<struct<id: bigint, planetIndex: bigint, faction: variant, race: variant,
    type: variant, campaignId: bigint, count: bigint>>,
  planetEvents: array<struct<id: bigint, eventId: bigint, planetIndex: bigint, eventType: bigint,
    race: variant, faction: variant, health: bigint, maxHealth: bigint, startTime: bigint,
    expireTime: bigint>>,
  spaceStations: array<struct<planetIndex: bigint, activeEffectIds: array<bigint>,
    currentElectionEndWarTime: variant>>,
  statistics: struct<playerCount: bigint>>"""
INFO = "struct<planetInfos: array<struct<index: bigint, name: string, sector: variant>>>"
ASSIGNMENTS = """array<struct<id32: bigint, id: bigint, title: string, briefing: string,
  setting: struct<overrideBrief: string, overrideTitle: string, tasks: variant>,
  tasks: variant, progress: array<bigint>, expiration: variant>>"""
STATS = "struct<statistics: struct<playerCount: bigint>, started: string, ended: string>"
NEWS = "array<struct<id: bigint, published: variant, type: variant, message: string>>"
LIVE = f"""struct<warStatus: {STATUS}, majorOrders: {ASSIGNMENTS}, news: {NEWS},
  spaceStations: array<struct<planetIndex: bigint, activeEffectIds: array<bigint>,
    currentElectionEndWarTime: variant>>>"""
ENTITIES = """array<struct<index: bigint, name: string, sector: string, currentOwner: string,
  health: bigint, maxHealth: bigint, players: bigint, attacking: variant,
  regenPerSecond: double, activeEffects: array<bigint>,
  statistics: struct<missionsWon: double, missionsLost: double, missionTime: double,
    terminidKills: double, automatonKills: double, illuminateKills: double, deaths: double,
    helldiversDeaths: double>>>"""
CONTESTS = """array<struct<id: bigint, faction: string, type: variant, eventType: bigint,
  campaignType: string, count: bigint, defendersProgress: double,
  planet: struct<index: bigint, name: string, sector: string, currentOwner: string>>>"""
WAR = """struct<statistics: struct<playerCount: bigint, missionsWon: bigint, missionsLost: bigint>,
  started: string, ended: string>"""
SERIES = """struct<data: array<struct<timestampUtc: string, totalPlayerCount: bigint,
  playerCountHumans: bigint, playerCountTerminids: bigint, playerCountAutomatons: bigint,
  playerCountIlluminate: bigint, impactMultiplier: double>>>"""
TRANSLATIONS = """struct<
  mo_brief: struct<title: string, original: string, translated: string, translated_at: string>,
  items: array<variant>>"""
NEWS_ITEM = """struct<id: bigint, original: string, translated: string, published_at: string,
  translated_at: string, source: string>"""

ATLAS = """struct<
  systems: array<struct<name: string, name_en: string,
    planets: array<struct<en: string, cn: string, id: bigint,
      position: struct<x: double, y: double>>>>>,
  planets: map<string, struct<ID: bigint, cn: string, system: string, sector: string,
    sector_en: string, position: struct<x: double, y: double>>>>"""
WAYPOINTS = "struct<waypoints: map<string, array<bigint>>>"
NAMES = "map<string, string>"
EFFECTS = "map<string, struct<galacticEffectId: bigint, name: string, description: string>>"
STATION_EFFECTS = "map<string, struct<name: string, cn: string, cn_full: string>>"
TAXONOMY = """struct<categories: array<struct<name: string, name_en: string,
  entries: array<struct<key: string, name: string, cn: string, `desc`: string,
    effect_ids: array<int>>>>>>"""
EQUIPMENT = """array<struct<id: string, name: string, type: string, stats: array<int>, bonus: int,
  subtag: array<string>>>"""

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_RAW = f"value string, {POLL} bigint"
# Ending of the table beside a kind's folders.
_ARCHIVE = ".archive"


def archive(documents: DataFrame, path: str) -> None:
    """Add documents ``(poll_ts, value)`` to the table of the kind whose folders lie at ``path``.

    A folder per document costs its commit, its listing and its opening; the table has as many
    files as tasks wrote it, however many polls they hold.
    """
    documents.select("value", F.col(POLL).cast("bigint").alias(POLL)).write.mode(
        "append").parquet(f"{path}{_ARCHIVE}")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a kind, ``(value, poll_ts)``: those in folders and those in its table."""
    folders, landed = health.optional(
        spark, _RAW, lambda: spark.read.schema(_RAW).text(path, wholetext=True)
    )
    table, archived = health.optional(
        spark, _RAW, lambda: spark.read.schema(_RAW).parquet(f"{path}{_ARCHIVE}")
    )
    if landed and archived:
        return folders.unionByName(table)
    return table if archived else folders


def read_documents(
    spark: SparkSession, path: str, kind: str, since: int | None = None, nullable: bool = False,
    extra: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row ``(poll_ts, doc)`` per valid document under ``path``, of polls from ``since`` on.

    ``extra`` adds a column of that name from the whole document, given as a variant.
    """
    found = read_with_defects(spark, path, kind, nullable).where(F.col("doc").isNotNull())
    if since is not None:
        found = found.where(F.col(POLL) >= since)  # prunes the folders of older polls
    if extra is None:
        return found.select(POLL, "doc")
    return found.select(POLL, "doc", extra(F.try_parse_json("value")).alias("extra"))


def _typed(value: str, kind: str, nullable: bool = False) -> Column:
    """The document, null where it is no JSON or its root is not what its readers take.

    A nullable document counts as delivered, and empty, when it is JSON null.
    """
    root = F.schema_of_variant(F.try_parse_json(value))
    listed = kind.startswith("array")
    right = root.startswith("ARRAY") if listed else root.startswith("OBJECT")
    if kind == ASSIGNMENTS:  # one assignment may come without its list
        right = right | root.startswith("OBJECT")
    doc = F.when(right, F.from_json(value, kind))
    if nullable:
        doc = doc.when(root == "VOID", F.from_json(F.lit("[]" if listed else "{}"), kind))
    return doc


def stream_arrivals(spark: SparkSession, landing: str, files: int = 100_000) -> DataFrame:
    """Stream ``(poll_ts)`` of every document that lands, whatever its kind.

    The poll is in the path, so no document is opened; a trigger admits ``files`` documents
    at most, oldest first.
    """
    landed = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .options(recursiveFileLookup=True, maxFilesPerTrigger=files)
        .load(landing)
    )
    poll = F.regexp_extract("path", f"{POLL}=([0-9]+)", 1)
    return landed.select(poll.try_cast("bigint").alias(POLL))


def read_with_defects(
    spark: SparkSession, path: str, kind: str, nullable: bool = False
) -> DataFrame:
    """One row ``(poll_ts, value, doc)`` per document; ``doc`` is null where it is defective."""
    return _raw(spark, path).select(POLL, "value", _typed("value", kind, nullable).alias("doc"))


def stage(
    spark: SparkSession, landing: str, kinds: dict[str, str], folder: str,
    since: int | None = None, nullable: frozenset = frozenset(),
    extras: dict[str, Callable[[Column], Column]] | None = None,
) -> dict[str, DataFrame]:
    """Parse each kind of document once, into nested parquet under ``folder``.

    Documents named in ``nullable`` count as delivered, and empty, when they are JSON null.
    ``extras`` gives a document's fields beyond its type, worked out of the whole document as a
    variant and kept as the column ``extra`` (see ``remainder``). What is read from there later
    reads only the nested fields it needs.
    """
    extras = extras or {}
    parsed = {
        name: read_documents(
            spark, f"{landing}/{name}", kind, since, name in nullable, extras.get(name))
        for name, kind in kinds.items()
    }
    return rewritten(parsed, folder)


def remainder(value: Column, own: Iterable[str], path: str = "$") -> Column:
    """The object at ``path`` of a variant without the fields ``own``, as JSON text.

    Null where nothing is left, where there is no such object or no object at all.
    """
    fields = F.try_variant_get(value, path, "map<string, variant>")
    others = F.map_filter(fields, lambda name, _: ~name.isin(*own))
    return F.when(F.size(others) > 0, F.to_json(others))


def remainders(value: Column, **own: tuple[str, Iterable[str]]) -> Column:
    """Per element of a list document a struct of ``remainder`` texts: name to (path, own)."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(
        listed, lambda item: F.struct(*[
            remainder(item, fields, path).alias(name) for name, (path, fields) in own.items()]))


def joined(left: Column, right: Column) -> Column:
    """Two JSON objects, as text, as one; ``right`` may be null, and neither is empty."""
    tail = F.concat(F.lit(","), F.substring(right, 2, (1 << 31) - 1))
    whole = F.concat(F.substring(left, F.lit(1), F.length(left) - 1), tail)
    return F.coalesce(whole, left)


def rewritten(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write tables side by side and read them back: later plans start from the written rows."""

    def write(name: str) -> DataFrame:
        df, path = tables[name], f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    with ThreadPoolExecutor(max_workers=8) as jobs:
        return dict(zip(tables, jobs.map(write, tables)))


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row ``(doc)`` per static document: a file or folder without polls."""
    raw, _ = health.optional(
        spark, "value string", lambda: spark.read.text(path, wholetext=True)
    )
    return raw.select(_typed("value", kind).alias("doc")).where(F.col("doc").isNotNull())


def items_with_extra(documents: DataFrame) -> DataFrame:
    """One row ``(poll_ts, seq, item, extra)`` per element of a list document."""
    pairs = documents.select(POLL, F.posexplode(F.arrays_zip("doc", "extra")).alias("seq", "z"))
    return pairs.select(POLL, "seq", F.col("z.doc").alias("item"), F.col("z.extra").alias("extra"))


def items(documents: DataFrame, path: Column, *keep: Column) -> DataFrame:
    """One row ``(poll_ts, seq, item)`` per list element, in document order."""
    return documents.select(POLL, *keep, F.posexplode(path).alias("seq", "item"))


def polls_of(*documents: DataFrame) -> DataFrame:
    """The polls for which every one of the documents arrived intact."""
    polls = documents[0].select(POLL).distinct()
    for other in documents[1:]:
        polls = polls.join(other.select(POLL).distinct(), POLL, "left_semi")
    return polls


def defects(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Per document ``(source, ok, rows, defective)``: what arrived and what was unreadable."""
    report = None
    for label, (path, kind) in paths.items():
        found = read_with_defects(spark, path, kind)
        row = found.agg(
            F.count("doc").alias("rows"), F.count_if(F.col("doc").isNull()).alias("defective")
        ).select(F.lit(label).alias("source"), (F.col("rows") > 0).alias("ok"), "rows", "defective")
        report = row if report is None else report.unionByName(row)
    return report
