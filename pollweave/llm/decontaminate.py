"""Benchmark passages in training documents, found with an FM-index per training shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pollweave.llm import kernels
from pollweave.llm.common import arrow_map, free_name, staged
from pollweave.llm.fm import FMIndex

WINDOW = 10
# A block of benchmark items is sent to every task: at most about this many bytes of text.
BLOCK_BYTES = 4 << 20
# A training shard is closed at so many indexed words, bytes of kept text or rows.
SHARD_WORDS = 1 << 20
SHARD_BYTES = 32 << 20
SHARD_ROWS = 20_000


class Phrases:
    """The distinct windows of a block of items, as symbols of the block's vocabulary."""

    def __init__(self, items: list, texts: list, window: int):
        data, offsets = kernels.utf8(pa.array(texts, pa.string()))
        starts, ends, first = kernels.words(data, offsets, kernels.PLAIN)
        found = kernels.span_hashes(data, starts, ends, folded=True)
        self.items = np.array(["" if i is None else str(i) for i in items], object)
        self.vocabulary = np.unique(found)
        self.size = len(self.vocabulary) + 1
        symbols = np.searchsorted(self.vocabulary, found) + 1
        counts = np.diff(first)
        lengths = np.minimum(counts, window)
        item_of = np.repeat(np.arange(len(texts)), counts)
        inner = np.flatnonzero(item_of[1:] == item_of[:-1])
        self.pairs = np.unique(symbols[inner] * self.size + symbols[inner + 1])
        self.groups = []
        for length in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == length)
            sizes = counts[own] - length + 1
            at = kernels.ragged(first[own], sizes)
            grid = symbols[at[:, None] + np.arange(length)]
            distinct, which = np.unique(grid, axis=0, return_inverse=True)
            owner = np.unique(np.stack([which.ravel(), np.repeat(own, sizes)]), axis=1)
            bounds = np.searchsorted(owner[0], np.arange(len(distinct) + 1))
            self.groups.append((int(length), distinct, bounds, owner[1]))
        long = [length for length, *_ in self.groups if length > 1]
        self.shortest = min(long, default=1 << 40)
        self.single = np.zeros(self.size, bool)
        for length, distinct, *_ in self.groups:
            if length == 1:
                self.single[distinct[:, 0]] = True
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 outside the vocabulary."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            may = np.flatnonzero(
                self._maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[may]), self.size - 2)
            out[may] = np.where(self.vocabulary[at] == hashes[may], at + 1, 0)
        return out

    def stretches(self, symbols: np.ndarray, first: np.ndarray):
        """Words that a window can cover, and which of them open a stretch.

        Any window of two words or more is a chain of word pairs that items have.
        """
        n = len(symbols)
        linked = np.zeros(n, bool)
        if n > 1 and len(self.pairs):
            both = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
            key = symbols[both] * self.size + symbols[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[both[self.pairs[at] == key] + 1] = True
            linked[first[:-1][first[:-1] < n]] = False
        stretch = np.cumsum(~linked) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= self.shortest if n else linked
        kept = np.flatnonzero(long | self.single[symbols])
        opens = ~linked[kept]
        return kept, opens


class Shard:
    """Consecutive rows of one task, their possible words indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.batches, self.words = [], []
        self.symbols, self.rows_of, self.at = [], [], []
        self.rows = self.indexed = self.bytes = 0

    def add(self, batch, kept_columns: list, text: str) -> None:
        data, offsets = kernels.utf8(batch.column(text))
        starts, ends, first = kernels.words(data, offsets, kernels.PLAIN)
        symbols = self.phrases.symbols(kernels.span_hashes(data, starts, ends, folded=True))
        kept, opens = self.phrases.stretches(symbols, first)
        place = np.arange(len(kept)) + np.cumsum(opens) - 1
        size = len(kept) + int(opens.sum())
        chain, row, at = (np.zeros(size, np.int64) for _ in range(3))
        chain[place] = symbols[kept]
        own = np.searchsorted(first, kept, side="right") - 1
        row[place] = own + self.rows
        at[place] = kept - first[own]
        self.symbols.append(chain)
        self.rows_of.append(row)
        self.at.append(at)
        self.words.append(np.diff(first))
        kept_batch = batch.select(kept_columns)
        self.batches.append(kept_batch)
        self.rows += batch.num_rows
        self.indexed += size
        self.bytes += kept_batch.nbytes

    def full(self) -> bool:
        return (self.indexed >= SHARD_WORDS or self.bytes >= SHARD_BYTES
                or self.rows >= SHARD_ROWS)

    def occurrences(self):
        """Row, start and end of all occurrences, and the (row, item) pairs."""
        symbols = np.concatenate([*self.symbols, np.zeros(1, np.int64)])
        rows, at = (np.concatenate([*x, np.zeros(1, np.int64)]) for x in (self.rows_of, self.at))
        spans, pairs = [], []
        if len(symbols) > 1:
            index = FMIndex(symbols, self.phrases.size)
            for length, windows, bounds, owners in self.phrases.groups:
                low, high = index.search(windows)
                place = index.locate(kernels.ragged(low, high - low))
                window = np.repeat(np.arange(len(windows)), high - low)
                row, start = rows[place], at[place]
                spans.append(np.stack([row, start, start + length]))
                seen = np.unique(np.stack([row, window]), axis=1)
                sizes = bounds[seen[1] + 1] - bounds[seen[1]]
                item = owners[kernels.ragged(bounds[seen[1]], sizes)]
                pairs.append(np.stack([np.repeat(seen[0], sizes), item]))
        none = [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        return np.concatenate(spans or none[0], axis=1), np.unique(
            np.concatenate(pairs or none[1], axis=1), axis=1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Row, start, end of the union of each row's spans."""
    row, start, end = spans[:, np.lexsort((spans[1], spans[0]))]
    if not len(row):
        return spans
    far = np.int64(1) << 32
    reach = np.maximum.accumulate(row * far + end)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * far + start[1:] > reach[:-1]
    opens = np.flatnonzero(new)
    last = np.append(opens[1:], len(row)) - 1
    return np.stack([row[opens], start[opens], reach[last] - row[opens] * far])


def lists(row: np.ndarray, values, low: int, high: int) -> pa.Array:
    """One list for each of the rows ``low`` to ``high``; ``row`` is sorted."""
    bounds = np.searchsorted(row, np.arange(low, high + 1))
    return pa.ListArray.from_arrays(
        pa.array(bounds - bounds[0], pa.int32()), pa.array(values[bounds[0] : bounds[-1]]))


def cut(text: str, starts, ends, separators=kernels.PLAIN) -> str:
    """``text`` without the words of the given spans and what stands between them."""
    data, offsets = kernels.utf8(pa.array([text]))
    first, last, _ = kernels.words(data, offsets, separators)
    body, at, parts = data.tobytes(), 0, []
    for start, end in zip(starts, ends, strict=True):
        parts.append(body[at : first[start]])
        at = last[end - 1]
    return b"".join([*parts, body[at:]]).decode("utf-8", "replace")


def without(column, row, start, end) -> pa.Array:
    """The texts without the spans of their rows; ``row`` is sorted."""
    found = column.to_pylist()
    rows, at = np.unique(row, return_index=True)
    for r, low, high in zip(rows, at, [*at[1:], len(row)], strict=True):
        found[r] = cut(found[r], start[low:high], end[low:high])
    return pa.array(found, column.type)


def _pass(
    df: DataFrame, phrases: Phrases, kept: list, text: str, names: dict, again: bool, remove: bool
) -> DataFrame:
    """Add (or extend, if ``again``) the columns of hits for one block of items."""
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
    schema = ", ".join([
        *types, f"`{names['n_words']}` bigint", f"`{names['starts']}` array<int>",
        f"`{names['ends']}` array<int>", f"`{names['items']}` array<string>"])
    carried = [names["starts"], names["ends"], names["items"]] if again else []

    def emit(shard: Shard):
        spans, pairs = shard.occurrences()
        if again:
            before, had = [], []
            base = 0
            for batch in shard.batches:
                s, e, i = (batch.column(c) for c in carried)
                sizes = s.value_lengths().to_numpy()
                row = base + np.repeat(np.arange(len(s)), sizes)
                before.append(np.stack([row, s.flatten().to_numpy(), e.flatten().to_numpy()]))
                had += [(base + n, x) for n, own in enumerate(i.to_pylist()) for x in own]
                base += batch.num_rows
            spans = np.concatenate([spans, *before], axis=1)
        spans = merged(spans)
        names_of = phrases.items[pairs[1]]
        rows = pairs[0]
        if again and had:
            rows = np.concatenate([rows, [r for r, _ in had]])
            names_of = np.concatenate([names_of, np.array([x for _, x in had], object)])
        both = sorted(set(zip(rows.tolist(), names_of.tolist(), strict=True)))
        rows = np.array([r for r, _ in both], np.int64)
        names_of = np.array([x for _, x in both], object)
        low = 0
        for batch, words in zip(shard.batches, shard.words, strict=True):
            high = low + batch.num_rows
            out = {c: batch.column(c) for c in kept}
            own = slice(*np.searchsorted(spans[0], [low, high]))
            if remove and own.start < own.stop:
                out[text] = without(out[text], spans[0][own] - low, spans[1][own], spans[2][own])
            out[names["n_words"]] = words
            out[names["starts"]] = lists(spans[0], spans[1], low, high)
            out[names["ends"]] = lists(spans[0], spans[2], low, high)
            out[names["items"]] = lists(rows, names_of, low, high)
            yield out
            low = high

    def function(batches):
        shard = Shard(phrases)
        for batch in batches:
            shard.add(batch, [*kept, *carried], text)
            if shard.full():
                yield from emit(shard)
                shard = Shard(phrases)
        if shard.batches:
            yield from emit(shard)

    return arrow_map(df, function, schema)


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Whether it is the last one, and the items of every block of about BLOCK_BYTES of text."""
    rows = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // BLOCK_BYTES) + 1
    for number in range(count):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        found = own.collect()
        yield number == count - 1, [r["item"] for r in found], [r["text"] for r in found]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: list | None = None,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    remove: bool = False,
) -> DataFrame:
    """The words of ``docs`` inside any occurrence of a window of a benchmark item.

    A window is ``window`` consecutive words of an item, or all words of a shorter one;
    words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    Every task closes its rows to shards, keeps the stretches of words that a window can
    cover, builds an FM-index over them, searches all windows backwards, locates the
    occurrences from sampled suffixes and merges their spans. Nothing is shuffled. The
    benchmark is read in blocks of bounded size, one pass over the documents for each: a
    pass is written before the next block is read, so the driver holds one block.

    Returns the columns ``keep`` (default: all) with ``n_words``, ``starts``, ``ends``
    (word numbers of the merged spans, ends exclusive) and ``items`` (distinct ids as
    sorted strings; a null id is an empty string); underscores follow a name that is
    taken. With ``remove`` the spans are cut from the text. Null and empty texts have no
    words and no hits; items without words hit nothing; an empty benchmark gives no hits;
    repeated rows are judged one by one; a hash of 64 bits stands for a word.
    """
    keep = docs.columns if keep is None else keep
    taken = docs.select(*keep)
    names = {n: free_name(taken, n) for n in ("n_words", "starts", "ends", "items")}
    source = docs.select(*dict.fromkeys([*keep, text]))
    for number, (last, items, passages) in enumerate(_blocks(benchmark, item, item_text)):
        kept = list(keep) if last else source.columns[: len(dict.fromkeys([*keep, text]))]
        source = _pass(source, Phrases(items, passages, window), kept, text, names, number > 0,
                       remove and last)
        if not last:
            source = staged(source, "benchmark-block")
    return source
