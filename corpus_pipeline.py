"""A training-data pipeline in five stages, each one operator of ``pollweave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pollweave.llm import common, decontaminate, packing, quality, similar, substrings
from pollweave.sources.tables import table


def _sized(docs: DataFrame, columns: list) -> DataFrame:
    """The given columns, ``n_chars`` counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the likelihood ratio.

    Each row is judged by itself, repeated rows alike, whatever its other columns hold. Null
    and empty texts have no words and go; an empty table stays empty. All columns stay as
    they are.
    """
    common.ready(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, model)
    verdict = judged.columns[-1]
    return judged.where(F.col(f"{verdict}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id.

    Rows without words (null, empty, blank) all stay. A null id stays only where its class
    has no other; of rows of one id and text the least stays; an empty table stays empty.
    """
    common.ready(spark)
    return similar.distinct(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller id holds; emptied documents go.

    Null and empty texts and texts without such passages stay as they are, as do rows of a
    null id. Rows of one id don't shorten each other and are shortened alike; an empty table
    stays empty. Columns of any name may stand beside; ``n_chars`` is counted anew.
    """
    common.ready(spark)
    key, digest, kept, emptied = (
        common.free_name(docs, n) for n in ("key", "digest", "kept", "emptied"))
    found = substrings.repeats(docs, with_text=True).where("n_removed > 0").select(
        F.col("key").alias(key), F.col("text_hash").alias(digest), F.col("kept_text").alias(kept),
        (F.col("n_removed") == F.col("n_words")).alias(emptied),
    ).dropDuplicates([key, digest])
    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = docs.join(
        found.hint("merge"), (own == F.col(digest)) & (F.col("doc_id") == F.col(key)), "left")
    cleaned = joined.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "text", F.coalesce(kept, "text"))
    return _sized(cleaned, docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of benchmark items; documents of nothing else go.

    Null and empty texts and texts without a window stay as they are; repeated rows are
    treated alike; an empty table or benchmark changes nothing. ``n_chars`` is counted anew.
    """
    common.ready(spark)
    found = decontaminate.find(
        docs, table(spark, sf_dir, "benchmark", "item_id", "text"), remove=True)
    n_words, starts, ends, _ = found.columns[-4:]
    hit = F.aggregate(
        F.zip_with(starts, ends, lambda s, e: e - s), F.lit(0), lambda x, y: x + y)
    emptied = (F.size(starts) > 0) & (hit == F.col(n_words))
    return _sized(found.where(~emptied), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences.

    A null text is empty and has the one id that ends a document. Repeated rows and null ids
    have pieces of their own; an empty table has none. Other columns are not read.
    """
    common.ready(spark)
    return packing.pack(packing.pieces(docs)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

# Tokens, FM-indexes and MinHash have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again as the next one's input."""
    common.ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
