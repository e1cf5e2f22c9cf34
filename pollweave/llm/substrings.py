"""Passages that repeat across documents, found with an FM-index per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pollweave.llm import kernels
from pollweave.llm.common import arrow_map, staged
from pollweave.llm.decontaminate import cut
from pollweave.llm.fm import FMIndex, matching_intervals, runs, suffix_array
from pollweave.llm.similar import Hasher, whole_groups

WINDOW = 50
ANCHOR = 10
# An anchor held by more documents goes by whole windows instead of a shard's index.
ANCHOR_ROWS = 20_000
# Windows of one stretch, and bytes of text in one shard.
STRETCH = 64
SHARD_BYTES = 4 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


class Windows:
    """All windows of a batch, each with its anchor: the least hash of its ANCHOR-grams.

    Equal windows have equal anchors, so all documents that share a window meet there.
    """

    def __init__(self, column, window: int):
        self.window = window
        short = min(ANCHOR, window)
        self.data, offsets = kernels.utf8(column)
        self.starts, self.ends, self.first = kernels.words(self.data, offsets, kernels.SPACED)
        self.hashes = kernels.span_hashes(self.data, self.starts, self.ends)
        grams = kernels.ngram_hashes(self.hashes, short)
        span, done = window - short + 1, 1
        while done < span:  # least of 1, 2, 4, ... and at last of `span` neighbours
            shift = min(done, span - done)
            grams = np.minimum(grams[: len(grams) - shift], grams[shift:])
            done += shift
        self.at = np.flatnonzero(kernels.whole_grams(self.first, window))
        self.anchor = grams[self.at]
        self.row = np.searchsorted(self.first, self.at, side="right") - 1

    def stretches(self, most: int):
        """First window, window count, anchor and row of runs with one anchor."""
        n = len(self.at)
        new = np.ones(n, bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        opens = np.flatnonzero(new)
        sizes = np.diff(np.append(opens, n))
        pieces = -(-sizes // most)
        inner = kernels.ragged(np.zeros(len(opens), np.int64), pieces)
        begin = np.repeat(opens, pieces) + inner * most
        size = np.minimum(np.repeat(opens + sizes, pieces) - begin, most)
        return begin, size, self.anchor[begin], self.row[begin]


def _signed(docs: DataFrame, window: int) -> DataFrame:
    """Per row: key, text_hash, n_words, the digest of its words, its anchors."""

    def function(batches):
        for batch in batches:
            found = Windows(batch.column("text"), window)
            begin, _, anchor, row = found.stretches(1 << 40)
            digests = [
                hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
                for t in batch.column("text").to_pylist()
            ]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield {
                "key": batch.column("key"),
                "text_hash": batch.column("text_hash"),
                "n_words": np.diff(found.first),
                "digest": digests,
                "anchors": pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(anchor.view(np.int64))),
            }

    return arrow_map(
        docs, function,
        "key bigint, text_hash binary, n_words bigint, digest string, anchors array<bigint>")


def _segments(candidates: DataFrame, window: int, hot: bool) -> DataFrame:
    """Stretches of text around wanted anchors, or the hashes of hot anchors' windows."""

    def chosen(found: Windows, batch, most: int):
        begin, size, anchor, row = found.stretches(most)
        wanted = batch.column("hot" if hot else "cold")
        own = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        values = wanted.flatten().to_numpy().view(np.uint64)
        pair = lambda rows, a: kernels.mixed(a + kernels.mixed(rows.astype(np.uint64)))
        keep = np.isin(pair(row, anchor), pair(own, values))
        return begin[keep], size[keep], anchor[keep], row[keep]

    def stretches(batches):
        for batch in batches:
            found = Windows(batch.column("text"), window)
            begin, size, anchor, row = chosen(found, batch, STRETCH)
            first = found.at[begin]
            low, high = found.starts[first], found.ends[first + size + window - 2]
            sizes = high - low
            body = found.data[kernels.ragged(low, sizes)]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(
                len(sizes), pa.py_buffer(offsets), pa.py_buffer(body))
            yield {
                "anchor": anchor.view(np.int64),
                "key": batch.column("key").take(pa.array(row)),
                "text_hash": batch.column("text_hash").take(pa.array(row)),
                "start": first - found.first[row],
                "text": text.cast(pa.string()),
            }

    def windows(batches):
        for batch in batches:
            found = Windows(batch.column("text"), window)
            begin, size, _, _ = chosen(found, batch, 1 << 40)
            own = kernels.ragged(begin, size)
            row = found.row[own]
            yield {
                "one": kernels.ngram_hashes(found.hashes, window)[found.at[own]].view(np.int64),
                "two": kernels.ngram_hashes(kernels.mixed(~found.hashes), window)[
                    found.at[own]].view(np.int64),
                "key": batch.column("key").take(pa.array(row)),
                "text_hash": batch.column("text_hash").take(pa.array(row)),
                "start": found.at[own] - found.first[row],
            }

    if hot:
        return arrow_map(candidates, windows,
                         "one bigint, two bigint, key bigint, text_hash binary, start bigint")
    return arrow_map(candidates, stretches,
                     "anchor bigint, key bigint, text_hash binary, start bigint, text string")


def _least_keys(rows: pa.Table, window: int):
    """For one shard: the least key of every window, by an FM-index over its segments."""
    data, offsets = kernels.utf8(rows.column("text"))
    starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
    hashes = kernels.span_hashes(data, starts, ends)
    keys = rows.column("key").to_numpy()
    sizes = np.diff(first)
    one, two = Hasher(1, 1, 1).sequences(hashes, first)
    order = np.lexsort((keys, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    own = order[new]  # of equal segments, that of the least key
    counts = sizes[own]
    vocabulary, symbol = np.unique(hashes, return_inverse=True)
    begin = np.cumsum(counts + 1) - counts - 1
    symbols = np.zeros(int((counts + 1).sum()), np.int64)
    symbols[kernels.ragged(begin, counts)] = symbol[kernels.ragged(first[own], counts)] + 1
    suffixes = suffix_array(symbols)
    index = FMIndex(symbols, len(vocabulary) + 1, suffixes)
    low = matching_intervals(index, symbols, suffixes, begin, counts, window)
    run = runs(symbols, suffixes, window)
    segment = np.repeat(np.arange(len(own)), counts + 1)
    holder = keys[own][segment[suffixes]]
    least = np.minimum.reduceat(holder, np.flatnonzero(np.diff(run, prepend=-1)))
    return which, counts - window + 1, least[run[low]]


def _shard_spans(segments: DataFrame, window: int) -> DataFrame:
    """Spans of words in windows that a smaller key holds too, shard by shard."""

    def function(batches):
        for rows, _ in whole_groups(batches, ["anchor"], SHARD_BYTES):
            which, counts, least = _least_keys(rows, window)
            base = np.cumsum(counts) - counts
            keys, starts = rows.column("key").to_numpy(), rows.column("start").to_numpy()
            sizes = counts[which]
            own = np.repeat(np.arange(len(which)), sizes)
            inner = kernels.ragged(np.zeros(len(which), np.int64), sizes)
            gone = keys[own] > least[base[which][own] + inner]
            own, place = own[gone], (starts[own] + inner)[gone]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
            opens = np.flatnonzero(new)
            last = np.append(opens[1:], len(own)) - 1
            yield {
                "text_hash": rows.column("text_hash").combine_chunks().take(pa.array(own[opens])),
                "start": place[opens],
                "stop": (place[last] + window) if len(own) else place,
            }

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return arrow_map(dealt, function, "text_hash binary, start bigint, stop bigint")


def _joined(spans) -> tuple[list, list]:
    starts, ends = [], []
    for start, stop in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], stop)
        else:
            starts.append(start)
            ends.append(stop)
    return starts, ends


def _cleaned(candidates: DataFrame, with_text: bool) -> DataFrame:
    """Of each text with spans: words removed, digest of the rest and, if asked, the rest."""

    def function(batches):
        for batch in batches:
            out = {"text_hash": batch.column("text_hash"), "n_removed": [], "kept_digest": [],
                   "kept_text": []}
            for text, spans in zip(
                batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True
            ):
                starts, ends = _joined((s["start"], s["stop"]) for s in spans)
                rest = cut(text, starts, ends, kernels.SPACED)
                kept = b" ".join(rest.encode().split())
                out["n_removed"].append(sum(ends) - sum(starts))
                out["kept_digest"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(rest if with_text else None)
            yield out

    return arrow_map(
        candidates, function,
        "text_hash binary, n_removed bigint, kept_digest string, kept_text string")


def repeats(
    docs: DataFrame,
    window: int = WINDOW,
    with_text: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: key, text_hash, n_words, n_removed, kept_sha256, kept_text.

    A word is removed if it lies in ``window`` words in a row that also start in a row of a
    smaller key, all judged on the input. Words end at ASCII white space. ``kept_sha256``
    is of the words left, joined by one space. ``kept_text`` (with ``with_text``) is the
    text without the removed words and what stands between them; null if nothing is
    removed. ``text_hash`` (MD5, 16 bytes) tells the texts apart.

    Each window has an anchor, the least hash of its ten-word grams. Anchors that several
    texts hold are found by one narrow aggregate; only the stretches around these are
    shuffled, by anchor. Every task closes its anchors to shards, builds an FM-index over
    a shard's distinct stretches, streams them through it backwards and takes from each
    window's interval the least key. An anchor that more than ANCHOR_ROWS rows hold goes
    another exact way: its windows are aggregated by 128-bit hash, so that no group is
    bounded or lost. Of equal texts only that of the least key is looked at; the others
    lose all words of windows.

    Keys must be whole numbers. A row with a null key neither loses words nor makes others
    lose any; rows of one key don't remove each other; null and empty texts have no words;
    an empty table gives no rows; other columns are not read.
    """
    source = docs.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"),
    ).withColumn("text_hash", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    signed = staged(_signed(source, window), "signed")
    keyed = signed.where("key is not null")
    first = keyed.groupBy("text_hash").agg(F.min("key").alias("first_key"))
    held = keyed.select("text_hash", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = staged(
        held.groupBy("anchor")
        .agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"),
             F.count(F.lit(1)).alias("rows"))
        .where("low <> high")
        .select("anchor", (F.col("rows") > ANCHOR_ROWS).alias("hot")),
        "anchors")
    chosen = keyed.join(first, "text_hash").where("key = first_key").dropDuplicates(
        ["text_hash"]).select("text_hash", "key", F.explode(F.array_distinct("anchors")).alias("anchor"))
    wanted = chosen.join(shared, "anchor").groupBy("text_hash", "key").agg(
        F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"),
        F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"))
    candidates = staged(
        source.where("text is not null").join(
            wanted.hint("merge"), ["text_hash", "key"]).dropDuplicates(
            ["text_hash"]),
        "candidates")
    spans = _shard_spans(_segments(candidates, window, hot=False), window)
    if not shared.where("hot").isEmpty():
        windows = _segments(candidates, window, hot=True)
        least = windows.groupBy("one", "two").agg(F.min("key").alias("least"))
        spans = spans.unionByName(
            windows.join(least, ["one", "two"]).where("key > least").select(
                "text_hash", "start", (F.col("start") + window).alias("stop")))
    by_text = spans.groupBy("text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cleaned = staged(
        _cleaned(candidates.select("text_hash", "text").join(by_text, "text_hash"), with_text),
        "cleaned")
    copy = F.col("key") > F.col("first_key")
    whole = F.col("n_words") >= window
    return (
        signed.drop("anchors")
        .join(first, "text_hash", "left")
        .join(cleaned, "text_hash", "left")
        .select(
            "key",
            "text_hash",
            "n_words",
            F.when(F.col("key").isNull(), 0)
            .when(copy, F.when(whole, F.col("n_words")).otherwise(0))
            .otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("key").isNull(), F.col("digest"))
            .when(copy, F.when(whole, F.lit(_EMPTY)).otherwise(F.col("digest")))
            .otherwise(F.coalesce("kept_digest", "digest")).alias("kept_sha256"),
            F.when(F.col("key").isNull(), F.lit(None))
            .when(copy, F.when(whole, F.lit("")))
            .otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )
