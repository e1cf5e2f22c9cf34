"""Near-duplicate documents: MinHash banding, then full n-gram sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pollweave.llm import kernels
from pollweave.llm.common import arrow_map, staged
from pollweave.llm.components import components

SHINGLE = 5
SIMILARITY = (4, 5)
RECALL = 0.9998
MOST_HASHES = 192
# Candidates are compared in blocks of so many texts.
BLOCK = 256
# Whole groups are gathered to chunks of about this many bytes of text.
CHUNK_BYTES = 4 << 20


def banding(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows per band within ``most`` hashes that reach the recall.

    A pair of Jaccard s meets in some band with probability 1 - (1 - s**rows)**bands.
    """
    best = None
    for rows in range(1, most + 1):
        share = similarity**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes cannot reach a recall of {recall}")
    return best


class Hasher:
    """Signatures of all rows of a batch at once."""

    def __init__(self, shingle: int, bands: int, rows: int):
        draw = np.random.Generator(np.random.PCG64(7))
        count = bands * rows
        self.shingle, self.bands, self.rows = shingle, bands, rows
        self.flip = draw.integers(0, 2**32, count, dtype=np.uint32)
        self.times = draw.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sequences(self, hashes, first) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the word sequence of every row that has words; else 0."""
        place = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            own = kernels.mixed(hashes + (place + np.uint64(1)) * np.uint64(salt))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
            out.append(kernels.mixed(sums[first[1:]] - sums[first[:-1]]))
        return out[0], out[1]

    def shingles(self, hashes, first) -> tuple[np.ndarray, np.ndarray]:
        """All shingles, and each row's first; a row of too few words has none."""
        grams = kernels.ngram_hashes(hashes, self.shingle)
        whole = kernels.whole_grams(first, self.shingle)[: len(grams)]
        counts = np.maximum(np.diff(first) - self.shingle + 1, 0)
        return grams[whole], np.concatenate([[0], np.cumsum(counts)])

    def bands_of(self, grams, first) -> tuple[np.ndarray, np.ndarray]:
        """The rows with shingles, and one hash per band for each of them."""
        rows = np.flatnonzero(np.diff(first))
        out = np.zeros((len(rows), self.bands), np.uint64)
        if not len(rows):
            return rows, out
        small = (grams >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(small)
        starts = first[rows]
        for band in range(self.bands):
            own = np.full(len(rows), band + 1, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                np.bitwise_xor(small, self.flip[k], out=value)
                np.multiply(value, self.times[k], out=value)
                own = kernels.mixed(own * np.uint64(31) + np.minimum.reduceat(value, starts))
            out[:, band] = own
        return rows, out


def _signatures(docs: DataFrame, hasher: Hasher) -> DataFrame:
    """Per row: key, text_hash, node (16 bytes, null without words), buckets."""

    def function(batches):
        for batch in batches:
            data, offsets = kernels.utf8(batch.column("text"))
            starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
            hashes = kernels.span_hashes(data, starts, ends)
            rows, bands = hasher.bands_of(*hasher.shingles(hashes, first))
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[rows] = hasher.bands
            yield {
                "key": batch.column("key"),
                "text_hash": batch.column("text_hash"),
                "node": _nodes(hasher, hashes, first),
                "buckets": pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                    pa.array(bands.ravel().view(np.int64))),
            }

    key = docs.schema["key"].dataType.simpleString()
    return arrow_map(
        docs.select("key", "text", F.xxhash64("text").alias("text_hash")), function,
        f"key {key}, text_hash bigint, node binary, buckets array<bigint>")


def _nodes(hasher: Hasher, hashes, first) -> pa.Array:
    both = np.stack(hasher.sequences(hashes, first), axis=1)
    raw = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(both), [None, pa.py_buffer(np.ascontiguousarray(both.byteswap()))])
    return pc.if_else(
        pa.array(np.diff(first) > 0), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _similar(sets: list, similarity: tuple, left: np.ndarray | None) -> np.ndarray:
    """Which pairs reach the similarity; with ``left`` only pairs across its two sides."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        shared[1] = shared[0][::-1]
    else:
        every, which = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(which) > 1
        column = np.cumsum(often) - 1
        row = np.repeat(np.arange(n), sizes)
        keep = often[which]
        row, column = row[keep], column[which[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((n, n), np.int64)
        for low in range(0, int(often.sum()), 8192):
            own = slice(*np.searchsorted(column, [low, low + 8192]))
            grid = np.zeros((n, 8192), np.float32)
            grid[row[own], column[own] - low] = 1
            shared += np.rint(grid @ grid.T).astype(np.int64)
    top, bottom = similarity
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared * bottom >= union * top
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    return linked


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def whole_groups(batches, columns: list, limit: int = CHUNK_BYTES):
    """Chunks of sorted rows that hold whole groups: table, and the groups' bounds."""
    held, most = None, limit
    for batch in batches:
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        if held.nbytes < most:
            continue
        held = held.combine_chunks()
        opens = _opens(held, columns)
        if len(opens) < 2:  # one group so far, and it may go on
            most *= 2
            continue
        last, most = int(opens[-1]), limit
        yield held.slice(0, last).combine_chunks(), opens
        held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, np.append(_opens(held, columns), held.num_rows)


def _opens(rows: pa.Table, columns: list) -> np.ndarray:
    """The first row of every group."""
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for c in columns:
        own = rows.column(c).combine_chunks().dictionary_encode()
        code = own.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def _verified(pairs: DataFrame, hasher: Hasher, similarity: tuple) -> DataFrame:
    """(node, parent, links) of every text in every block, from full shingle sets."""

    def function(batches):
        for rows, bounds in whole_groups(batches, ["candidate", "i", "j"]):
            data, offsets = kernels.utf8(rows.column("text"))
            starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
            hashes = kernels.span_hashes(data, starts, ends)
            grams, begin = hasher.shingles(hashes, first)
            nodes = np.array(rows.column("node").to_pylist(), object)
            copies = rows.column("copies").to_numpy()
            block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
            parent, links = nodes.copy(), np.zeros(len(nodes), np.int64)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high - low < 2:
                    continue
                sets = [np.unique(grams[begin[r] : begin[r + 1]]) for r in range(low, high)]
                left = block[low:high] if i[low] != j[low] else None
                linked = _similar(sets, similarity, left)
                links[low:high] = linked @ copies[low:high]
                parent[low:high] = nodes[low + _least_reached(linked)]
            yield {"node": pa.array(nodes.tolist(), pa.binary()),
                   "parent": pa.array(parent.tolist(), pa.binary()), "links": links}

    return arrow_map(pairs, function, "node binary, parent binary, links bigint")


def _solved(source: DataFrame, similarity: tuple, shingle: int, recall: float):
    """The rows' signatures, and every node with its chosen row, component and links."""
    bands, rows = banding(similarity[0] / similarity[1], recall)
    hasher = Hasher(shingle, bands, rows)
    signed = staged(_signatures(source, hasher), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min_by(F.struct("key", "text_hash"), F.struct(F.col("key").isNull(), "key", "text_hash"))
        .alias("chosen"),
        F.count(F.lit(1)).alias("copies"),
        F.first("buckets").alias("buckets"),
    )
    nodes = staged(nodes.select("node", "chosen.*", "copies", "buckets"), "nodes")
    buckets = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    ties = buckets.join(shared.select("bucket", "low"), "bucket").where("node <> low").select(
        F.col("node").alias("u"), F.col("low").alias("v"))
    candidates = staged(
        components(ties).select("node", F.col("component").alias("candidate")), "candidates")
    forest = _forest(source, nodes, candidates, hasher, similarity)
    roots = components(forest.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    links = forest.groupBy("node").agg(F.sum("links").alias("links"))
    classed = (
        nodes.select("node", "key", "text_hash", "copies")
        .join(roots, "node", "left")
        .join(links, "node", "left")
        .select("node", "key", "text_hash", "copies",
                F.coalesce("component", "node").alias("component"),
                F.coalesce("links", F.lit(0)).alias("links"))
    )
    return signed, staged(classed, "components")


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def classes(
    docs: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: key, class_id, n_links, n_copies.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle`` words in
    a row is at least ``similarity`` (a fraction); texts of fewer words only if their
    words are the same. ``class_id`` is the least key that links lead to; ``n_links``
    counts the other rows linked to this one, copies included; ``n_copies`` the rows of
    the same words. Words end at ASCII white space.

    Texts of the same words are one node. Nodes meet in buckets of MinHash bands (number
    and rows chosen for ``recall``); buckets that hold several tie nodes to candidate
    groups, and all pairs of a group are compared on their full sets, in blocks of BLOCK
    texts so that no group goes to one task. Blocks return link counts and a spanning
    forest, never the pairs.

    Rows without words (null, empty, blank) are classes of their own with no links, under
    their own key. Null keys are least in no class unless it has no other; repeated rows
    are copies. An empty table gives no rows; other columns are not read.
    """
    signed, classed = _solved(_source(docs, key, text), similarity, shingle, recall)
    least = classed.groupBy("component").agg(F.min("key").alias("class_id"))
    by_node = staged(
        classed.join(least, "component").select(
            "node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies"),
        "classes")
    return signed.select("key", F.col("node").alias("own")).join(
        by_node, F.col("own") == F.col("node"), "left").select(
            "key",
            F.when(F.col("own").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        )


def distinct(
    docs: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay if one of each class does: that of the least key.

    Classes are those of ``classes``; a null key stays only where a class has no other, and
    of rows of one key and text the least as JSON. Rows without words all stay. All columns are returned as they are.
    """
    _, classed = _solved(_source(docs, key, text), similarity, shingle, recall)
    chosen = classed.groupBy("component").agg(
        F.min_by(F.struct("key", "text_hash"), F.struct(F.col("key").isNull(), "key", "text_hash"))
        .alias("chosen")).select(
            F.col("chosen.key").alias("__key"), F.col("chosen.text_hash").alias("__hash"))
    body = F.col(text).cast("string")
    # The text goes with its row once: what the join needs of it is worked out before.
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("own"), F.xxhash64(body).alias("hash"),
        F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    kept = rows.where("worded").join(
        chosen.hint("merge"), (F.col("hash") == F.col("__hash")) & F.col("own").eqNullSafe(F.col("__key")),
        "left_semi")
    repeated = (
        docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("hash"))
        .groupBy("key", "hash").count().where("count > 1"))
    if not repeated.isEmpty():  # rows of one key and text: the least of them as JSON
        kept = kept.groupBy("own", "hash").agg(
            F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return kept.select("row.*").unionByName(rows.where(~F.col("worded")).select("row.*"))


def _forest(source, nodes, candidates, hasher, similarity) -> DataFrame:
    """Verified links of all candidate groups, reduced to (node, parent, links)."""
    sizes = candidates.groupBy("candidate").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = (
        candidates.join(sizes, "candidate")
        .join(nodes.drop("buckets"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    texts = source.select(
        F.col("key").alias("text_key"), "text", F.xxhash64("text").alias("own_hash")
    ).where("text is not null")
    with_text = texts.join(
        placed.hint("merge"),
        (F.col("text_hash") == F.col("own_hash")) & F.col("key").eqNullSafe(F.col("text_key")),
    ).dropDuplicates(["node"])
    pairs = with_text.select(
        "candidate", "node", "copies", "block", "text",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.struct(
                F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
        ).alias("pair"),
    ).select("candidate", "pair.i", "pair.j", "block", "node", "copies", "text")
    dealt = pairs.repartition("candidate", "i", "j").sortWithinPartitions("candidate", "i", "j", "node")
    return staged(_verified(dealt, hasher, similarity), "forest")
