"""Token ids in files of raw ids with a minimal perfect hash index for access by key.

A file holds the ids of its documents one after the other, then an index, then a footer:

    "TOKENID1"
    ids, little-endian, ``width`` bytes each
    documents:  Arrow stream of key (string), offset (in ids), length
    slots:      Arrow stream of fingerprint, first document, number of documents
    shifts:     Arrow stream of one displacement per bucket
    footer:     5 little-endian 64-bit numbers: width, ids, then the byte sizes of
                documents, slots and shifts
    "TOKENID1"

A key's hash gives a bucket; the bucket's displacement gives the key's slot, without any
search; the slot's fingerprint tells whether the key is there, and its entry the key's
documents (several if the key is repeated).
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pollweave.llm import kernels
from pollweave.llm.common import arrow_map, staged
from pollweave.llm.encoding import encoder
from pollweave.llm.files import opened
from pollweave.session import run_folder

MAGIC = b"TOKENID1"
END = 2
# A file is closed at so many ids or documents.
FILE_IDS = 16 << 20
FILE_DOCS = 200_000
_BUCKET = 4
_GOLDEN, _FULL = 0x9E3779B97F4A7C15, 1 << 64


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each key's text; null is a key of its own."""
    data, offsets = kernels.utf8(keys.cast(pa.string()).fill_null("\0"))
    return kernels.span_hashes(data, offsets[:-1], offsets[1:])


def _draws(hashes: np.ndarray):
    """Bucket draw, start, odd factor and fingerprint of a key."""
    one = kernels.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    two = kernels.mixed(hashes ^ np.uint64(0x14057B7EF767814F))
    factor = kernels.mixed(two) | np.uint64(1)
    return one, two, factor, (one >> np.uint64(32)).astype(np.uint32)


def build(hashes: np.ndarray) -> np.ndarray:
    """One displacement per bucket so that distinct hashes fill slots 0 to n - 1.

    Buckets are settled from the fullest on: the displacement is the first that brings
    all keys of the bucket to free slots. A bucket of one key takes any free slot, given
    as -1 - slot.
    """
    n = len(hashes)
    shifts = np.zeros(n // _BUCKET + 1, np.int64)
    bucket_draw, start, factor, _ = _draws(hashes)
    bucket = (bucket_draw % np.uint64(len(shifts))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(shifts))
    first = np.cumsum(sizes) - sizes
    free = bytearray(b"\1") * n
    by_size = np.argsort(-sizes, kind="stable")
    many = int((sizes > 1).sum())
    for b in by_size[:many].tolist():
        own = order[first[b] : first[b] + sizes[b]]
        at, by = start[own].tolist(), factor[own].tolist()
        shift = 0
        while True:
            add = shift * _GOLDEN
            slots = {((a + add) * f % _FULL >> 32) % n for a, f in zip(at, by, strict=True)}
            if len(slots) == len(at) and all(free[s] for s in slots):
                break
            shift += 1
            if shift > 64 * n + (1 << 16):
                raise ValueError("two keys share a 64-bit hash")
        for s in slots:
            free[s] = 0
        shifts[b] = shift
    rest = iter(np.flatnonzero(np.frombuffer(free, np.uint8)).tolist())
    for b in by_size[many:].tolist():
        if sizes[b]:
            shifts[b] = -1 - next(rest)
    return shifts


def slots_of(hashes: np.ndarray, shifts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each hash and its fingerprint; a constant number of reads per key."""
    bucket_draw, start, factor, fingerprint = _draws(hashes)
    shift = shifts[(bucket_draw % np.uint64(len(shifts))).astype(np.int64)]
    added = start + np.maximum(shift, 0).astype(np.uint64) * np.uint64(_GOLDEN)
    drawn = ((added * factor) >> np.uint64(32)) % np.uint64(n)
    return np.where(shift < 0, -1 - shift, drawn.astype(np.int64)), fingerprint


def _stream(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


class Writer:
    """One file, written front to back; only its index is held in memory."""

    def __init__(self, folder: str, width: int):
        self.fs, path = opened(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC)
        self.width, self.ids = width, 0
        self.keys, self.lengths = [], []

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys.cast(pa.string()))
        self.lengths.append(lengths)
        self.ids += len(ids)

    def docs(self) -> int:
        return sum(map(len, self.keys))

    def close(self) -> dict:
        keys, lengths = pa.concat_arrays(self.keys), np.concatenate(self.lengths)
        offsets = np.cumsum(lengths) - lengths
        hashes = key_hashes(keys)
        # equal keys stand side by side, as documents come in order
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        distinct = hashes[first]
        shifts = build(distinct)
        slot, fingerprint = slots_of(distinct, shifts, len(distinct))
        order = np.argsort(slot)
        parts = [
            _stream(key=keys, offset=offsets, length=lengths),
            _stream(fingerprint=fingerprint[order], first=first[order],
                    docs=np.diff(np.append(first, len(hashes)))[order]),
            _stream(shift=shifts),
        ]
        for part in parts:
            self.out.write(part)
        footer = np.array([self.width, self.ids, *map(len, parts)], "<u8")
        self.out.write(footer.tobytes() + MAGIC)
        self.out.close()
        return {"file": self.name, "docs": len(hashes), "ids": self.ids,
                "first_key": keys[0].as_py(), "last_key": keys[-1].as_py()}


class Reader:
    """Access to one file's documents by key."""

    def __init__(self, folder: str, name: str):
        fs, path = opened(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        end = self.file.size()
        tail = self._read(end - 48, 48)
        if tail[-8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        self.width, self.ids, *sizes = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        at = 8 + self.width * self.ids
        tables = []
        for size in sizes:
            tables.append(pa.ipc.open_stream(self._read(at, size)).read_all().combine_chunks())
            at += size
        docs, slots, shifts = tables
        self.keys = docs.column("key").combine_chunks()
        self.offset, self.length = (docs.column(c).to_numpy() for c in ("offset", "length"))
        self.fingerprint, self.first, self.docs = (
            slots.column(c).to_numpy() for c in ("fingerprint", "first", "docs"))
        self.shifts = shifts.column("shift").to_numpy()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if absent.

        An absent key is taken for another with a chance of 2**-32.
        """
        slot, fingerprint = slots_of(key_hashes(keys), self.shifts, len(self.first))
        there = self.fingerprint[slot] == fingerprint
        return self.first[slot], np.where(there, self.docs[slot], 0)

    def span(self, offset: int, length: int) -> np.ndarray:
        raw = self._read(8 + int(offset) * self.width, int(length) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key) -> list[np.ndarray]:
        """The ids of every document of ``key``."""
        first, docs = self.find(pa.array([None if key is None else str(key)], pa.string()))
        return [self.span(self.offset[n], self.length[n])
                for n in range(first[0], first[0] + docs[0])]


def write(
    docs: DataFrame,
    folder: str | None = None,
    end: int = END,
    width: int = 2,
    vocabulary: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[str, DataFrame]:
    """Write all documents in ascending key order; the folder and the manifest of its files.

    Keys are range-partitioned and sorted; each task encodes its texts, adds ``end`` to
    each and writes files of at most FILE_IDS ids. Only files in the manifest (file, part,
    number, docs, ids, first_key, last_key, base) count: what a lost attempt wrote has a name
    of its own and is in no manifest. The keys lead to a key's files (``holding``); ``base``
    is the number of ids in all files before. Null keys come
    first, rows of one key in order of their text; a null text is empty; an empty table
    gives an empty manifest. ``width`` is 2 bytes for vocabularies below 65536, else 4.
    """
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "token-ids")
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    dealt = source.repartitionByRange("key").sortWithinPartitions("key", "text")

    def function(batches):
        encode, part, number, writer = encoder(vocabulary), TaskContext.get().partitionId(), 0, None

        def closed():
            row = writer.close()
            return {k: [v] for k, v in {**row, "part": part, "number": number}.items()}

        for batch in batches:
            ids, first = encode.batch(batch.column("text"))
            sizes = np.diff(first)
            bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
            every = np.full(bounds[-1], end, np.uint32)
            every[kernels.ragged(bounds[:-1], sizes)] = ids
            if len(every) and int(every.max()) >> (8 * width):
                raise ValueError(f"an id does not fit {width} bytes")
            writer = writer or Writer(folder, width)
            writer.add(batch.column("key"), every, sizes + 1)
            if writer.ids >= FILE_IDS or writer.docs() >= FILE_DOCS:
                yield closed()
                writer, number = None, number + 1
        if writer:
            yield closed()

    written = staged(
        arrow_map(
            dealt, function,
            "file string, part int, number int, docs bigint, ids bigint, first_key string, "
            "last_key string"),
        "token-manifest")
    kind = docs.schema[key].dataType
    written = written.withColumns(
        {c: F.col(c).cast(kind) for c in ("first_key", "last_key")})
    # One row per file: the only unpartitioned window, over a list that fits any task.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return folder, written.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def holding(manifest: DataFrame, key) -> DataFrame:
    """The manifest's files that may hold ``key``: one, or those that its rows run across."""
    if key is None:
        return manifest.where("first_key is null")
    return manifest.where(
        (F.col("first_key").isNull() | (F.col("first_key") <= key)) & (F.col("last_key") >= key))


def _numbers(file: Reader) -> np.ndarray:
    """Every key's document, as the hash index places it: repeated keys in their order."""
    hashes = key_hashes(file.keys)
    run = np.ones(len(hashes), bool)
    run[1:] = hashes[1:] != hashes[:-1]
    begin = np.maximum.accumulate(np.where(run, np.arange(len(hashes)), 0))
    first, docs = file.find(file.keys)
    again = np.arange(len(hashes)) - begin
    if (again >= docs).any():
        raise ValueError("the index misses keys")
    return first + again


def read(spark_manifest: DataFrame, folder: str) -> DataFrame:
    """key (as string), start, n_tokens, ids_crc32 of every document, through the index.

    A key's place in its file is what the perfect hash gives; offset, length and ids are
    read there.
    """

    def function(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(folder, row["file"])
                numbers = _numbers(file)
                for low in range(0, len(numbers), 4096):
                    own = numbers[low : low + 4096]
                    offset, length = file.offset[own], file.length[own]
                    begin = offset.min()
                    ids = file.span(begin, (offset + length).max() - begin)
                    at = offset - begin
                    yield {
                        "key": file.keys[low : low + 4096],
                        "start": row["base"] + offset,
                        "n_tokens": length,
                        "ids_crc32": [
                            zlib.crc32(ids[a : a + n].tobytes())
                            for a, n in zip(at, length, strict=True)
                        ],
                    }

    spread = spark_manifest.repartition("file")
    return arrow_map(spread, function,
                     "key string, start bigint, n_tokens bigint, ids_crc32 bigint")
