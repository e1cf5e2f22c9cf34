"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pollweave.llm import (
    checks,
    common,
    conversations,
    decontaminate,
    language,
    licenses,
    merkle,
    mixing,
    packing,
    quality,
    sharding,
    similar,
    substrings,
    token_files,
    warc,
)
from pollweave.sources.tables import table

SHARDS = 40
MIX_WEIGHTS = (1, 2, 3)


def op1_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    return sharding.assign(docs, [1.0] * SHARDS).select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op2_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    found = licenses.scan(docs, keep=["doc_id"])
    base = F.filter("licenses.detections", lambda d: d["kind"] == "base")
    one = found.select(
        "doc_id", "licenses.n_words", base.alias("base"), F.col("licenses.kept").alias("kept"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    label = lambda found: F.transform(found, lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return one.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.array_distinct(label("base"))).alias("base_labels"),
        joined(F.array_union(label("base"), label("kept"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)).alias(
            "score"),
    )


def op3_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ready(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=["doc_id"]).select("doc_id", "quality.*")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(common.ready(spark), sf_dir, "pages", "page_id", "url", "html")
    folder, manifest = warc.write(pages)
    return warc.read(manifest, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        "refers_to")


def op5_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs)).withColumnRenamed("key", "doc_id")


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    return similar.classes(docs).withColumnRenamed("key", "doc_id")


def op7_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    folder, manifest = token_files.write(docs)
    return token_files.read(manifest, folder).select(
        F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    return substrings.repeats(docs).select(
        F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op9_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "text")
    return packing.pack(packing.pieces(docs)).withColumnRenamed("key", "doc_id")


def _joined_digest(column: str):
    """Distinct strings of an array, sorted and comma-joined, as SHA-256."""
    return F.sha2(F.array_join(F.array_sort(column), ","), 256)


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ready(spark)
    found = decontaminate.find(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
        keep=["doc_id"],
    )
    hit = F.aggregate(
        F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")),
        F.lit(0).cast("long"),
        lambda x, y: x + y,
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        _joined_digest("items").alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op11_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(
        common.ready(spark), sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest([*named, F.col("text")])
    damaged = merkle.leaf_digest([*named, F.translate("text", "\n", "")])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(
        docs, leaf, carry={"claimed": F.when(tampered, damaged).otherwise(leaf)})
    folded = found.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("proof")))
    return folded.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults: dropped, emptied, cut, repeated or of another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    fault = F.crc32(place.cast("binary")) % 20
    text = F.when(fault == 1, "").when(
        fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def op12_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(
        common.ready(spark), sf_dir, "conversations", "conv_id", "turn", "role", "text")
    faulty = damaged(turns)
    figures, words = conversations.report(faulty)
    told = conversations.digests(conversations.repair(faulty, words))
    every = turns.select("conv_id").distinct().withColumn(
        "g", conversations.named(F.col("conv_id")))
    rows = every.join(figures.join(told, "g"), "g", "left")
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "conv_id",
        *map(long, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(common.ready(spark), sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs, MIX_WEIGHTS).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {
    "op1_rendezvous": (op1_rendezvous, None),
    "op2_signatures": (op2_signatures, None),
    "op3_likelihood_ratio": (op3_likelihood_ratio, None),
    "op4_warc": (op4_warc, checks.WARC),
    "op5_rank_order": (op5_rank_order, None),
    "op6_minhash_join": (op6_minhash_join, checks.DUPLICATES),
    "op7_perfect_hash": (op7_perfect_hash, None),
    "op8_fm_index": (op8_fm_index, checks.REPEATS),
    "op9_least_squares": (op9_least_squares, None),
    "op10_fm_index": (op10_fm_index, checks.CONTAMINATION),
    "op11_time_forward": (op11_time_forward, checks.MERKLE),
    "op12_bidirectional": (op12_bidirectional, checks.REPAIR),
    "op13_sainte_lague": (op13_sainte_lague, checks.MIX),
}
