"""Language by rank-order profiles of character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pollweave.llm.common import arrow_map

# Grams of 1 to 3 letters; this many of a document's and of a language's most frequent.
PROFILE = 300
# At most so many documents of each language are learned from.
LEARNED_ROWS = 1500
UNKNOWN = "und"
_EDGE = ord("_")
_BITS = 21
# Characters of texts that are counted side by side.
_CHUNK = 1_500_000


@cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[n for n in range(0x110000) if chr(n).isalpha()]] = True
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, words and texts edged by "_", and their rows."""
    lowered = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in lowered]])
    row = np.maximum(row - 1, 0)
    letter = _letters()[codes]
    keep = letter.copy()  # of other characters only the first behind a letter, or at a start
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    codes = np.where(letter, codes, _EDGE)[keep].astype(np.int64)
    return codes, row[keep]


def _slices(text: str):
    """The codes of one text, as ``_codes`` has them, in slices of _CHUNK characters."""
    lowered = text.lower()
    for low in range(0, len(lowered), _CHUNK):
        high = min(low + _CHUNK, len(lowered))
        left = lowered[low - 1] if low else "\n"
        right = lowered[high] if high < len(lowered) else "\n"
        around = left + lowered[low:high] + right
        codes = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:-1] |= letter[1:]
        keep[0] &= low == 0  # the neighbours belong to other slices
        keep[-1] &= high == len(lowered)
        yield np.where(letter, codes, _EDGE)[keep].astype(np.int64)


def _long_profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of one text, counted slice by slice; the last two codes are carried over."""
    gram, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    carried = np.zeros(0, np.int64)
    for own in _slices(text):
        codes = np.concatenate([carried, own])
        edge, done = codes == _EDGE, len(carried)
        found = [codes[done:][~edge[done:]]]
        pairs = (codes[:-1] << _BITS) | codes[1:]
        inner = ~(edge[:-1] & edge[1:])
        found.append(pairs[max(done - 1, 0):][inner[max(done - 1, 0):]])
        if len(codes) > 2:
            triples = (pairs[:-1] << _BITS) | codes[2:]
            found.append(triples[max(done - 2, 0):][~edge[1:-1][max(done - 2, 0):]])
        every, number = np.unique(np.concatenate(found), return_counts=True)
        gram, at = np.unique(np.concatenate([gram, every]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([count, number])).astype(np.int64)
        carried = codes[-2:]
    return gram, count


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of all grams of each text, by row and gram.

    A gram of one to three characters is one number; shorter grams sort before longer
    ones. Words are runs of letters; "_" stands for a word's edge in grams of two or three.
    """
    if len(texts) == 1 and len(texts[0]) > _CHUNK:
        gram, count = _long_profile(texts[0])
        return np.zeros(len(gram), np.int64), gram, count
    codes, row = _codes(texts)
    alphabet, dense = np.unique(codes, return_inverse=True)
    size = len(alphabet)
    edge = codes == _EDGE
    base = size + size**2 + size**3
    own = row * base
    found = [(own + dense)[~edge]]
    if len(codes) > 1:
        pair = dense[:-1] * size + dense[1:]
        # two edges side by side belong to two words
        found.append((own[1:] + size + pair)[~(edge[:-1] & edge[1:])])
    if len(codes) > 2:
        triple = pair[:-1] * size + dense[2:]
        found.append((own[1:-1] + size + size**2 + triple)[~edge[1:-1]])
    every = np.concatenate(found)
    if len(texts) * base < 2**31:
        every = every.astype(np.int32)
    every.sort()
    new = np.flatnonzero(np.diff(every, prepend=-1))
    count = np.diff(np.append(new, len(every)))
    row, gram = np.divmod(every[new].astype(np.int64), base)
    return row, _packed(gram, alphabet), count


def _packed(gram: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Grams numbered by a chunk's alphabet to grams numbered by code points."""
    size = len(alphabet)
    out = np.zeros(len(gram), np.int64)
    one, two = gram < size, (gram >= size) & (gram < size + size**2)
    out[one] = alphabet[gram[one]]
    left, right = np.divmod(gram[two] - size, size)
    out[two] = (alphabet[left] << _BITS) | alphabet[right]
    three = ~(one | two)
    left, right = np.divmod(gram[three] - size - size**2, size)
    left, middle = np.divmod(left, size)
    out[three] = (alphabet[left] << 2 * _BITS) | (alphabet[middle] << _BITS) | alphabet[right]
    return out


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int = PROFILE):
    """(row, gram, rank) of each row's most frequent grams; ties by gram."""
    order = np.lexsort((gram, -count, row)) if len(row) < 1000 else _by_count(row, count)
    row, gram = row[order], gram[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < most
    return row[keep], gram[keep], rank[keep]


def _by_count(row, count) -> np.ndarray:
    """Rows are sorted by row and gram already: sort one number of row, count and place."""
    n, top = len(row), int(count.max()) + 1
    if (int(row[-1]) + 1) * top * n >= 2**62:
        return np.lexsort((-count, row))
    key = (row * top + (top - 1 - count)) * n + np.arange(n)
    key.sort()
    return key % n


def _chunks(texts: list):
    """Ranges of texts of about _CHUNK characters; a longer text is alone."""
    low, size = 0, 0
    for n, text in enumerate(texts):
        if len(text) > _CHUNK and low < n:
            yield low, n
            low, size = n, 0
        size += len(text)
        if size >= _CHUNK:
            yield low, n + 1
            low, size = n + 1, 0
    if low < len(texts):
        yield low, len(texts)


class Model:
    """Rank of every gram in each language's profile."""

    def __init__(self, rows):
        self.languages = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.rank = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        number = {lang: n for n, lang in enumerate(self.languages)}
        for r in rows:
            self.rank[number[r["lang"]], np.searchsorted(self.grams, r["gram"])] = r["rank"]

    def predict(self, texts: list[str]) -> tuple[list, list]:
        """Language and score of each text: 1 minus its distance as a share of the most."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return lang, score
        for low, high in _chunks(texts):
            row, gram, rank = ranked(*profiles(texts[low:high]))
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at = np.where(self.grams[at] == gram, at, len(self.grams))
            there = self.rank[:, at]
            off = np.where(there < 0, PROFILE, np.abs(there - rank))
            rows = high - low
            away = np.stack([np.bincount(row, weights=x, minlength=rows) for x in off])
            grams = np.bincount(row, minlength=rows)
            best = away.argmin(axis=0)
            for n in np.flatnonzero(grams):
                lang[low + n] = self.languages[best[n]]
                score[low + n] = 1.0 - float(away[best[n], n]) / float(PROFILE * grams[n])
        return lang, score


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3


def fit(
    docs: DataFrame,
    most: int = LEARNED_ROWS,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """Profiles of all languages, from rows whose key's CRC-32 leaves 0 or 2 of 3.

    Of each language at most ``most`` rows are learned from: keys are thinned by hash to
    about twice as many, so that no language goes whole to one task, and those of least
    hash are taken. Rows without a letter, language or key teach nothing and take no place.
    Only profiles, at most PROFILE rows per language, come to the driver.
    """
    teachable = F.col(text).cast("string").rlike(r"\p{L}")
    known = docs.where(teachable).select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang")).where(
        "key is not null and lang is not null").where(remainder(F.col("key")) != 1)
    share = known.groupBy("lang").agg((2.0 * most / F.count(F.lit(1))).alias("share"))
    draw = F.xxhash64("key", F.lit("learned"))
    thin = (F.shiftrightunsigned(draw, 11).cast("double") / F.lit(float(1 << 53))) < F.col("share")
    first = Window.partitionBy("lang").orderBy("draw", "key")
    chosen = (
        known.join(share, "lang").where(thin).withColumn("draw", draw)
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
        .select("key", "lang").distinct()
    )
    texts = docs.select(
        F.col(key).alias("own"), F.col(lang).cast("string").alias("own_lang"),
        F.col(text).cast("string").alias("text"),
    ).where("text is not null")
    learned = texts.join(
        chosen, (F.col("own") == F.col("key")) & (F.col("own_lang") == F.col("lang"))
    ).select("lang", "text")

    def function(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            names, which = np.unique(np.array(langs, object), return_inverse=True)
            for low, high in _chunks(texts):
                row, gram, count = profiles(texts[low:high])
                own = which[low:high][row]
                order = np.lexsort((gram, own))
                own, gram, count = own[order], gram[order], count[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])
                opens = np.flatnonzero(new)
                if len(opens):
                    yield {"lang": names[own[opens]].tolist(), "gram": gram[opens],
                           "n": np.add.reduceat(count, opens)}

    counts = arrow_map(learned, function, "lang string, gram bigint, n bigint")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn(
        "rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    return Model(top.select("lang", "gram", "rank").collect())


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, held_out, lang_pred and score of every row, from its whole text alone.

    The language is that of the least out-of-place distance: the difference of ranks
    summed over the text's PROFILE most frequent grams, PROFILE for a gram that the
    language's profile lacks; of equal ones the first by name. Texts that are null or
    hold no letter are ``und`` with score 0, as are all texts if nothing was learned.
    ``held_out`` is whether the key's CRC-32 leaves 1 of 3 (false for a null key).
    Repeated rows have repeated results; an empty table has none.
    """
    source = docs.select(
        F.col(key).alias("key"),
        F.coalesce(remainder(F.col(key)) == 1, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    kind = source.schema["key"].dataType.simpleString()

    def function(batches):
        for batch in batches:
            lang, score = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield {"key": batch.column("key"), "held_out": batch.column("held_out"),
                   "lang_pred": lang, "score": score}

    return arrow_map(source, function, f"key {kind}, held_out boolean, lang_pred string, score double")
