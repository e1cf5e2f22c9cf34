"""Keyed state between runs, as versioned parquet in a shared folder.

A run writes ``version=<n>`` and reads lower versions only, so a run that is
repeated after a failure reads the same state and replaces its own output.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pollweave.functions import fixed
from pollweave.operators import history
from pollweave.session import written
from pollweave.sources import health

VERSION = "version"


def save(df: DataFrame, folder: str, version: int) -> None:
    """Write one version, replacing an earlier attempt at it."""
    df.write.mode("overwrite").parquet(f"{folder}/{VERSION}={version}")


def load(spark: SparkSession, folder: str, schema: T.StructType | str, version: int) -> DataFrame:
    """One version; empty when it was never written."""
    path = f"{folder}/{VERSION}={version}"
    found, _ = health.optional(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    return found


def load_all(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All versions with their number."""
    if isinstance(schema, str):
        versioned = f"{schema}, {VERSION} bigint"
    else:
        versioned = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
    found, _ = health.optional(
        spark, versioned, lambda: spark.read.schema(versioned).parquet(folder)
    )
    return found


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all complete versions, from the folder's names alone: no file is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if "=" in p.getName())


def load_before(spark: SparkSession, folder: str, schema: T.StructType | str, version: int) -> DataFrame:
    """The newest version older than ``version``; empty when there is none."""
    older = [v for v in versions(spark, folder) if v < version]
    if not older:
        return spark.createDataFrame([], schema)
    return load(spark, folder, schema, max(older))


def load_latest_rows(
    spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str]
) -> DataFrame:
    """Per key the row of the newest version that has the key."""
    rows = load_all(spark, folder, schema)
    return history.last_per_key(rows, keys, [F.col(VERSION)]).drop(VERSION)


# Versions after which changes are reduced to a snapshot.
FOLDED = 32


def save_change(
    rows: DataFrame, folder: str, version: int, reduce: Callable[[DataFrame], DataFrame]
) -> None:
    """Write one version of changes to ``folder/out``; every FOLDED versions also a snapshot.

    ``reduce`` brings rows of several versions (with their number) to what they amount to.
    Readers start from the newest snapshot, so they never read more than FOLDED versions.
    """
    save(rows, f"{folder}/out", version)
    if version % FOLDED == FOLDED - 1:
        whole = load_changed(rows.sparkSession, folder, rows.schema, reduce, version + 1)
        save(whole, f"{folder}/snapshot", version)


def load_changed(
    spark: SparkSession, folder: str, schema: T.StructType | str,
    reduce: Callable[[DataFrame], DataFrame], before: int | None = None,
) -> DataFrame:
    """What the changes of all versions, or those before one, amount to."""
    found = [v for v in versions(spark, f"{folder}/snapshot") if before is None or v < before]
    since = max(found, default=-1)
    rows = load_all(spark, f"{folder}/out", schema).where(F.col(VERSION) > since)
    if before is not None:
        rows = rows.where(F.col(VERSION) < before)
    if found:
        known = load(spark, f"{folder}/snapshot", schema, since)
        rows = rows.unionByName(known.withColumn(VERSION, F.lit(since).cast("bigint")))
    return reduce(rows)


def append_history(
    spark: SparkSession,
    folder: str,
    incoming: DataFrame,
    keys: list[str],
    order: list[Column],
    version: int,
    k: int = fixed.HISTORY_RECORDS,
) -> DataFrame:
    """Add the records whose key is new, keep the last ``k``, write and return the result.

    ``order`` puts the newest record first.
    """
    store = load_before(spark, folder, incoming.schema, version)
    kept = history.retention_tail(history.append_if_absent(store, incoming, keys), order, k)
    save(kept, folder, version)
    return load(spark, folder, incoming.schema, version)


# Buckets of a keyed table.
BUCKETS = 64
BUCKET = "bucket"


def _buckets_at(spark: SparkSession, folder: str, before: int | None) -> dict[int, int]:
    """The version that each bucket was written in last, before ``before``."""
    found = [v for v in versions(spark, f"{folder}/buckets") if before is None or v < before]
    if not found:
        return {}
    rows = load(spark, f"{folder}/buckets", f"{BUCKET} int, at bigint", max(found)).collect()
    return {r[BUCKET]: r["at"] for r in rows}


def load_keyed(
    spark: SparkSession, folder: str, schema: T.StructType | str, before: int | None = None,
    only: Collection[int] | None = None,
) -> DataFrame:
    """The rows of a keyed table: of its newest version or the one before ``before``.

    ``only`` names buckets; no file of another one is listed or read.
    """
    at = _buckets_at(spark, folder, before)
    paths = [
        f"{folder}/rows/{VERSION}={version}/{BUCKET}={bucket}"
        for bucket, version in sorted(at.items()) if only is None or bucket in only
    ]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return functools.reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def update_cache(
    spark: SparkSession, folder: str, fresh: DataFrame, keys: list[str], version: int
) -> DataFrame:
    """Upsert rows into a keyed table; write this version and return the whole table.

    A key's bucket is decided by its hash. Only buckets that fresh keys fall into are read,
    and only those where a row is new or differs are written again; a list of BUCKETS numbers
    tells where each bucket lies. Of several fresh rows of a key the least counts.
    """
    others = [F.col(c) for c in fresh.columns if c not in keys]
    placed = written(
        history.first_per_key(fresh, keys, others).withColumn(
            BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), "fresh")
    at = _buckets_at(spark, folder, version)
    near = load_keyed(spark, folder, fresh.schema, version, _buckets(placed))
    changed = written(
        placed.join(near, _same(placed, near, fresh.columns), "left_anti"), "changed")
    hit = _buckets(changed)
    if hit:
        old = load_keyed(spark, folder, fresh.schema, version, hit)
        kept = old.join(changed, _same(old, changed, keys), "left_anti").withColumn(
            BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        merged = kept.unionByName(changed).repartition(BUCKET)
        merged.write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{folder}/rows/{VERSION}={version}")
    lies = {**at, **{bucket: version for bucket in hit}}
    save(spark.createDataFrame(sorted(lies.items()), f"{BUCKET} int, at bigint"),
         f"{folder}/buckets", version)
    return load_keyed(spark, folder, fresh.schema, version + 1)


def _buckets(rows: DataFrame) -> set[int]:
    """The buckets that rows fall into: BUCKETS at most."""
    return {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}
