"""Quality rules: counts of a text and a hashed n-gram likelihood ratio."""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.llm.common import free_name, likely, settled, staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# One- and two-word grams fall into so many buckets each.
BUCKETS = 8192
# Texts of fewer words fail.
LEAST_WORDS = 10
# Shares of the trusted documents that the threshold may cost; each must bring PRICE times as
# large a share of the rejected ones.
LOST = [n / 1000 for n in range(2, 21)]
PRICE = 10
# A word bucket tells toxic texts if it is in more of them than in trusted ones by so many
# standard deviations; its log-likelihood ratio of the two counts so many times.
SURE = 4
TOXIC = 4
_SCALE = 10_000


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each bucket in ten-thousandths, and the least score kept."""

    weights: list
    threshold: float


def _words(text: str) -> Column:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.regexp_extract_all(body, F.lit(WORD), F.lit(0))


def _next(left: Column, right: Column, shift: int, combine) -> Column:
    """Combine every value of ``left`` with the value ``shift`` places on in ``right``."""
    size = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, 1, size), F.slice(right, shift + 1, size), combine)


def _pairs(hashes: str) -> Column:
    return _next(F.col(hashes), F.col(hashes), 1, lambda a, b: F.xxhash64(a, b))


def _buckets(hashes: str, pairs: str) -> Column:
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS))),
        F.transform(pairs, lambda h: F.pmod(h, F.lit(BUCKETS)) + BUCKETS),
    )


def _hashed(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """Words, their hashes and those of word pairs, each in a projection of its own."""
    one = df.select(*keep, F.col(text).cast("string").alias("text"), _words(text).alias("words"))
    two = one.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return two.select("*", _pairs("hashes").alias("pairs"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Bucket weights from all documents and the labelled ones, and a threshold.

    Trusted are documents that a label gives quality 1 and not toxic and none rejects;
    rejected are those of quality 0 or toxic. Every row of a labelled key counts. Weights
    are the log ratio of trusted and raw counts, 1 added; word buckets that surely tell
    toxic texts have TOXIC times the log ratio of toxic and trusted counts taken off. Of the
    quantiles LOST of the trusted scores the threshold is the one where the share of
    rejected documents below it, less PRICE times the quantile, is largest. Only bucket
    counts and quantiles come to the driver, whatever the input. Without trusted documents
    all weights are 0 and nothing is rejected by score.
    """
    said = lambda condition: F.coalesce(F.bool_or(F.expr(condition)), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("marked")).agg(
        said("quality = 1 and toxic = 0").alias("good"),
        said("quality = 0 or toxic = 1").alias("bad"),
        said("toxic = 1").alias("toxic"),
    ).where("good or bad")
    marks = staged(marks, "marks")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Labelled texts meet their marks by shuffle at every size; a filter keeps the others back.
    labelled = staged(
        texts.where(likely(marks, "marked")(F.col("key"))).join(
            marks.hint("merge"), F.col("key") == F.col("marked")).select(
            "text", "bad", "toxic", (F.col("good") & ~F.col("bad")).alias("own")),
        "labelled-texts")
    raw = _hashed(texts, "text").select(
        F.explode(_buckets("hashes", "pairs")).alias("bucket")).groupBy("bucket").count()
    # From 2 * BUCKETS on: documents that hold the word bucket.
    once = F.transform(
        F.array_distinct(F.transform("hashes", lambda h: F.pmod(h, F.lit(BUCKETS)))),
        lambda bucket: bucket + 2 * BUCKETS)
    grams = _hashed(labelled, "text", F.col("own"), F.col("toxic")).select(
        "own", "toxic", F.explode(F.concat(_buckets("hashes", "pairs"), once)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(
        F.count_if("own").alias("own"), F.count_if("toxic").alias("toxic"))
    docs_of = labelled.agg(F.count_if("own").alias("own"), F.count_if("toxic").alias("toxic"))
    weights = _ratios(raw.collect(), counts.collect(), docs_of.first())
    scored = _hashed(labelled, "text", F.col("own"), F.col("bad")).where(
        F.size("words") >= LEAST_WORDS).select(
            "own", "bad", _score("hashes", "pairs", weights).alias("score"))
    score = lambda kind: F.when(F.col(kind), F.col("score"))
    found = scored.agg(
        F.percentile(score("own"), F.lit(LOST)).alias("own"),
        F.percentile(score("bad"), F.lit([n / 1000 for n in range(1001)])).alias("bad"),
    ).first()
    if not found.own:
        return Model(weights, float("-inf"))
    below = lambda least: bisect_left(found.bad or [], least) / 1001
    _, threshold = max(
        zip(LOST, found.own, strict=True), key=lambda x: below(x[1]) - PRICE * x[0])
    return Model(weights, threshold)


def _ratios(raw_rows, labelled_rows, docs_of) -> list:
    from math import log, sqrt

    raw, own, toxic = ([0] * (3 * BUCKETS) for _ in range(3))
    for row in raw_rows:
        raw[row.bucket] = row["count"]
    for row in labelled_rows:
        own[row.bucket], toxic[row.bucket] = row.own, row.toxic
    weights = []
    for low in (0, BUCKETS):  # one multinomial of words, one of pairs
        at = range(low, low + BUCKETS)
        known = sum(own[low : low + BUCKETS])
        shift = log(sum(raw[b] + 1 for b in at)) - log(known + BUCKETS)
        weights += [log(own[b] + 1) - log(raw[b] + 1) + shift if known else 0.0 for b in at]
    words = sum(own[:BUCKETS])
    if words and docs_of.own and docs_of.toxic:
        grams, share = sum(toxic[:BUCKETS]) / words, docs_of.toxic / docs_of.own
        for b in range(BUCKETS):
            expected = own[b + 2 * BUCKETS] * share
            noise = sqrt(expected * (1 + share) + 1)
            if toxic[b + 2 * BUCKETS] - expected > SURE * noise:
                ratio = log(toxic[b] + 1) - log(own[b] * grams + 1)
                weights[b] -= TOXIC * max(ratio, 0.0)
    return [round(_SCALE * w) for w in weights]


def _score(hashes: str, pairs: str, weights: list) -> Column:
    """Mean log-likelihood ratio of a text's grams; 0 without grams."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<int>")
    total = F.aggregate(
        _buckets(hashes, pairs), F.lit(0).cast("long"),
        lambda sum_, bucket: sum_ + F.get(table, bucket.cast("int")))
    grams = F.size(hashes) + F.size(pairs)
    return F.when(grams > 0, total / (grams * F.lit(float(_SCALE)))).otherwise(F.lit(0.0))


def judge(
    docs: DataFrame, model: Model, keep: list | None = None, text: str = "text"
) -> DataFrame:
    """The columns ``keep`` (default: all) with a struct ``quality`` (or ``quality_`` ...).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed (fewer than 10 words, or over a fifth of the words in five-word windows
    that the text repeats) and kept: not base_failed, and score at least the threshold.
    Words end at ASCII white space. Each row is judged by itself, repeated rows alike;
    null and empty texts have no words and fail; an empty table gives no rows. A window
    is told by a hash of 64 bits.
    """
    keep = docs.columns if keep is None else keep
    name = free_name(docs.select(*keep), "quality")
    table = _hashed(docs, text, F.struct(*keep).alias("row"))
    fours = _next(F.col("pairs"), F.col("pairs"), 2, lambda a, b: F.xxhash64(a, b))
    table = table.select("*", fours.alias("fours"))
    fives = _next(F.col("fours"), F.col("hashes"), 4, lambda a, b: F.xxhash64(a, b))
    table = table.select("*", fives.alias("fives")).drop("fours")
    lines = F.filter(
        F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    table = table.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
        _score("hashes", "pairs", model.weights).alias("score"),
        F.when(
            F.size(F.array_distinct("fives")) < F.size("fives"),
            F.array_sort(F.transform("fives", lambda h, n: F.struct(h.alias("h"), n.alias("n")))),
        ).alias("sorted"),
    )
    # Equal windows stand side by side: their places, in order of the text.
    places = F.array_sort(F.transform(
        F.filter(
            "sorted",
            lambda x, i: F.coalesce(F.get(F.col("sorted"), i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(F.col("sorted"), i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["n"]))
    table = table.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("sorted").isNotNull(), places).alias("places"),
    ).drop("lines", "sorted")
    covered = F.aggregate(
        _next(F.col("places"), F.col("places"), 1, lambda a, b: F.least(F.lit(5), b - a)),
        F.lit(5), lambda x, y: x + y)
    table = table.select(
        "*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("places")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    verdict = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score",
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= model.threshold)).alias("kept"),
    )
    return settled(table, "row", verdict, name)
