"""A compressed FM-index over integer symbols: wavelet matrix, sampled suffixes.

All queries run side by side: every step is a few array operations over all of them.
"""

from __future__ import annotations

import numpy as np

from pollweave.llm import kernels


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; symbol 0 ends a segment and never equals another."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = np.zeros(n, np.int64)
        key[: n - step] = rank[step:] + 1 if step < n else 0
        # ranks are below 2**31, so both parts fit one word
        key += rank << 32
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        change = np.empty(n, np.int64)
        change[0] = 0
        change[1:] = sorted_key[1:] != sorted_key[:-1]
        np.cumsum(change, out=change)
        rank = np.empty(n, np.int64)
        rank[order] = change
        if change[-1] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Bit planes of a sequence, packed, with a running count per 64 bits."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        values = values.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1 == 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int32)
            before[1:] = np.cumsum(np.bitwise_count(packed[:-1]))
            self.bits.append(packed)
            self.counts.append(before)
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        symbols = np.arange(size)
        self.base = self._down(symbols, np.zeros(size, np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, at)
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, at)
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol, at - self.base[symbol]


class FMIndex:
    """Backward search over segments of symbols 1..size-1, each closed by a 0."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, size: int, order: np.ndarray | None = None):
        self.n = len(symbols)
        order = suffix_array(symbols) if order is None else order
        self.wavelet = Wavelet(symbols[order - 1], size)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # A suffix is sampled if its place is a multiple of SAMPLE or opens a segment;
        # stepping back from any other suffix stays in its segment.
        opens = np.zeros(self.n, bool)
        opens[0] = True
        opens[1:] = symbols[:-1] == 0
        sampled = (order % self.SAMPLE == 0) | opens[order]
        self.places = order[sampled].astype(np.int32)
        padded = np.zeros((self.n // 64 + 1) * 64, bool)
        padded[: self.n] = sampled
        self._marks = np.packbits(padded, bitorder="little").view(np.uint64)
        self._marks_before = np.zeros(len(self._marks), np.int64)
        self._marks_before[1:] = np.cumsum(np.bitwise_count(self._marks[:-1]))

    def step(self, symbol, low, high):
        """Extend each interval's pattern by ``symbol`` on the left."""
        return (
            self.below[symbol] + self.wavelet.rank(symbol, low),
            self.below[symbol] + self.wavelet.rank(symbol, high),
        )

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each row of ``patterns``, all of one length."""
        count, length = patterns.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for k in reversed(range(length)):
            low[live], high[live] = self.step(patterns[live, k], low[live], high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(low, high)
        gone = np.ones(count, bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix, by steps back to a sampled one."""
        rows, place = rows.copy(), np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            bit = (at & 63).astype(np.uint64)
            word = self._marks[at >> 6]
            marked = (word >> bit) & np.uint64(1) == 1
            number = self._marks_before[at >> 6] + np.bitwise_count(
                word & ((np.uint64(1) << bit) - np.uint64(1)))
            done = live[marked]
            place[done] = self.places[number[marked]] + steps[done]
            live = live[~marked]
            symbol, before = self.wavelet.access(rows[live])
            rows[live] = self.below[symbol] + before
            steps[live] += 1
        return place


def runs(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The run of each suffix row: rows whose first ``depth`` symbols are the same.

    A suffix that meets the end of its segment before is a run of its own.
    """
    n = len(symbols)
    grams = np.zeros(n, np.uint64)
    found = kernels.ngram_hashes(kernels.mixed(symbols.astype(np.uint64)), depth)
    grams[: len(found)] = found
    ends = np.flatnonzero(symbols == 0)
    after = ends[np.minimum(np.searchsorted(ends, np.arange(n)), len(ends) - 1)]
    whole = after - np.arange(n) >= depth
    same = np.zeros(n, bool)
    left, right = order[:-1], order[1:]
    same[1:] = whole[left] & whole[right] & (grams[left] == grams[right])
    return np.cumsum(~same) - 1


def matching_intervals(
    index: FMIndex, symbols: np.ndarray, order: np.ndarray, starts, sizes, width: int
) -> np.ndarray:
    """A suffix row of the interval of every window of ``width`` symbols of each segment.

    Segments are read backwards side by side. Once ``width`` symbols match, the interval
    is first widened to all suffixes that share the first ``width - 1``, so that every
    symbol costs one backward step. Windows come in order of segment and start.
    """
    run = runs(symbols, order, width - 1)
    opens = np.flatnonzero(np.diff(run, prepend=-1))
    closes = np.append(opens[1:], len(run))
    counts = np.maximum(sizes - width + 1, 0)
    base = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    low = np.zeros(len(sizes), np.int64)
    high = np.full(len(sizes), index.n, np.int64)
    ordered = sizes[by_size]
    for t in range(int(ordered[0]) if len(ordered) else 0):
        live = int(np.searchsorted(-ordered, -t, side="left"))  # those longer than t
        low, high, own = low[:live], high[:live], by_size[:live]
        if t >= width:
            at = run[low]
            low, high = opens[at], closes[at]
        place = sizes[own] - 1 - t
        low, high = index.step(symbols[starts[own] + place], low, high)
        if t >= width - 1:
            out[base[own] + place] = low
    return out
