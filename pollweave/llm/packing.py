"""Documents packed to sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pollweave.llm import kernels
from pollweave.llm.common import arrow_map, staged
from pollweave.llm.encoding import encoder
from pollweave.llm.ordering import numbered

WINDOW = 1024
END = 0
# Combinations of three lengths that the solver may choose from, at most.
TRIPLES = 100_000
STEPS = 400


def pieces(
    docs: DataFrame,
    window: int = WINDOW,
    end: int = END,
    vocabulary: str | None = None,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids) of each document's pieces.

    A document is its text's ids and ``end``, cut to ``window`` ids from its start on. A
    null text is empty, so every row has a piece; repeated rows have pieces of their own.
    """

    def function(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids, first = encode.batch(batch.column("text"))
            sizes = np.diff(first)
            bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
            every = np.full(bounds[-1], end, np.uint32)
            every[kernels.ragged(bounds[:-1], sizes)] = ids
            tokens = sizes + 1
            count = -(-tokens // window)
            row = np.repeat(np.arange(len(tokens)), count)
            start = kernels.ragged(np.zeros(len(tokens), np.int64), count) * window
            length = np.minimum(tokens[row] - start, window)
            at = bounds[row] + start
            out = {
                "key": batch.column("key").take(pa.array(row)),
                "start": start,
                "length": length,
                "ids_crc32": [
                    zlib.crc32(every[a : a + n].astype("<u4").tobytes())
                    for a, n in zip(at, length, strict=True)
                ],
                "doc_tokens": tokens[row],
            }
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(length)])
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(edges, pa.int32()), pa.array(every.astype(np.int32)))
            yield out

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return arrow_map(
        source, function,
        f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
        + (", ids array<int>" if with_ids else ""))


@dataclass(frozen=True)
class Plan:
    """Which ranks of each length go to which sequences.

    Entry n gives the pieces of ``length`` from rank ``first`` on, ``times`` of them to
    each of the sequences ``base``, ``base`` + 1, ...; they start at ``offset`` there.
    """

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.int64(1) << 40
        at = np.searchsorted(self.length * far + self.first, length * far + rank, "right") - 1
        inner, times = rank - self.first[at], self.times[at]
        return self.base[at] + inner // times, self.offset[at] + inner % times * length


def combinations(window: int, most: int = TRIPLES) -> np.ndarray:
    """Two or three lengths that fill a window, as rows in rising order, 0 for none.

    Of triples those of the shortest least part come first, as far as ``most`` reaches.
    """
    low = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(low), low, window - low], axis=1)]
    total = 0
    for least in range(1, window // 3 + 1):
        middle = np.arange(least, (window - least) // 2 + 1)
        total += len(middle)
        if total > most:
            break
        found.append(np.stack([np.full_like(middle, least), middle, window - least - middle], axis=1))
    return np.concatenate(found)


def repeat_counts(histogram: np.ndarray, parts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with least squared difference of its combinations' lengths to the histogram.

    Accelerated projected gradient; every column of the matrix has three entries at most.
    """
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale
    valid = (parts > 0).astype(float)

    def lengths(x):
        return np.bincount(
            parts.ravel(), weights=(valid * x[:, None]).ravel(), minlength=len(histogram))

    def gradient(x):
        return ((lengths(x) - target)[parts] * valid).sum(axis=1)

    degree = np.bincount(parts[parts > 0], minlength=len(histogram)).max()
    step = 1.0 / (3.0 * degree)
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * gradient(y), 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if (gradient(y) * (new - x)).sum() > 0:  # uphill: drop the momentum
            y, t_new = new, 1.0
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray) -> Plan:
    """Pack ``histogram[n]`` pieces of each length n; the window is the longest length.

    The solved counts are rounded and used as far as pieces last; what is left is packed
    greedily, longest piece first, each time with the longest that still fits, and a
    pattern is used as often as its pieces allow.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    used: list[tuple[int, list[int]]] = []
    if left[window]:
        used.append((int(left[window]), [window]))
        left[window] = 0
    parts = combinations(window)
    if left.any() and len(parts):
        x = repeat_counts(left, parts)
        for n in np.argsort(-x, kind="stable"):
            want = int(x[n] + 0.5)
            if want < 1:
                break
            own = [int(p) for p in parts[n] if p][::-1]
            often = min(int(left[p]) // own.count(p) for p in own)
            often = min(often, want)
            if often:
                used.append((often, own))
                for p in own:
                    left[p] -= often
    while left.any():
        rest, own = left.copy(), []
        gap = window
        while gap:
            fit = np.flatnonzero(rest[: gap + 1])
            if not len(fit):
                break
            own.append(int(fit[-1]))
            rest[fit[-1]] -= 1
            gap -= int(fit[-1])
        often = min(int(left[p]) // own.count(p) for p in own)
        used.append((often, own))
        for p in own:
            left[p] -= often
    return _plan(used, window)


def _plan(used: list, window: int) -> Plan:
    rows, base = [], 0
    taken = np.zeros(window + 1, np.int64)
    for often, own in used:
        offset = 0
        for p in sorted(set(own), reverse=True):
            times = own.count(p)
            rows.append((p, int(taken[p]), base, times, offset))
            taken[p] += often * times
            offset += p * times
        base += often
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=base)


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``parts`` (of ``pieces``) with sequence_id and offset, both gapless from 0.

    Only the histogram of lengths, ``window`` rows, comes to the driver. Pieces are
    numbered within their length and read their place off the plan, which has a bounded
    number of entries; nothing else is shuffled. No piece, no sequence.
    """
    written = staged(parts, "pieces")
    rows = written.groupBy("length").count().collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in rows:
        histogram[row["length"]] = row["count"]
    solved = plan(histogram)
    ranked = numbered(written, ["length"], ["key", "start", "ids_crc32"], "rank")
    names = parts.columns

    def function(batches):
        for batch in batches:
            sequence, offset = solved.place(
                batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield {**{c: batch.column(c) for c in names}, "sequence_id": sequence, "offset": offset}

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return arrow_map(ranked, function, f"{types}, sequence_id bigint, offset bigint")
