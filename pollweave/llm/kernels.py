"""Words and their hashes over whole Arrow batches, with numpy.

A batch of texts is one byte array with offsets. Both word definitions used here separate
at ASCII bytes only, so UTF-8 needs no decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Words end at white space (0x20, 0x09-0x0D) and nowhere else.
SPACED = np.zeros(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = True

# Words are runs of ASCII letters, digits and all other non-ASCII characters.
PLAIN = np.zeros(256, bool)
PLAIN[:0x80] = True
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_EXACT = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_FOLDED = _EXACT.copy()
_FOLDED[0x41:0x5B] = _EXACT[0x61:0x7B]

_BYTE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
_powers = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < size:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = _powers[int(base)] = np.cumprod(steps)
    return table[:size]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Start and end byte of every word, and each row's first word number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts, ends, folded: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span; ``folded`` lower-cases A-Z."""
    table = _FOLDED if folded else _EXACT
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        size = int(ends[to - 1] - low)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(
            table[data[low : low + size]] * _power_table(_BYTE, max(size, _BLOCK))[:size],
            out=sums[1:],
        )
        s, e = starts[at:to] - low, ends[at:to] - low
        back = _power_table(_BYTE_INVERSE, max(size, _BLOCK))
        out[at:to] = mixed((sums[e] - sums[s]) * back[s])
        at = to
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values, rows not regarded."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, length, square, span = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if n & span:
                if done is None:
                    done = square
                else:
                    shift = np.uint64(pow(int(_WORD), span, 2**64))
                    size = len(h) - length - span + 1
                    done = done[:size] * shift + square[length : length + size]
                length += span
            if length == n:
                return mixed(done[: len(h) - n + 1])
            shift = np.uint64(pow(int(_WORD), span, 2**64))
            size = len(h) - 2 * span + 1
            square = square[:size] * shift + square[span : span + size]
            span *= 2


def whole_grams(first_word: np.ndarray, n: int) -> np.ndarray:
    """Which positions start an n-gram that ends in the same row."""
    total = int(first_word[-1])
    size = max(total - n + 1, 0)
    ends = np.repeat(first_word[1:], np.diff(first_word))
    return np.arange(size) + n <= ends[:size]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - begin, sizes)
