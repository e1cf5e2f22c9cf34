"""WARC archives: range-sorted records, files rolled by compressed size, read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pollweave.llm.common import arrow_map, staged
from pollweave.llm.files import opened
from pollweave.session import run_folder

# A file is closed once its compressed size reaches this.
FILE_BYTES = 64 << 20
# Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
# Archives must not differ between runs, so the date of records is a parameter.
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{key} {digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _header(value: str | None) -> str:
    """A header value on one line; what cannot stand there is percent-encoded."""
    from urllib.parse import quote

    return "" if value is None else quote(value, safe="!#$%&'()*+,/:;=?@[]~ -._")


def page_record(key, url, payload: bytes, size: int, digest: str, refers) -> bytes:
    """A response with its payload, or (with ``refers``) a revisit without."""
    common = [
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if key is None else str(key)),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is None:
        block = head + f"Content-Length: {size}\r\n\r\n".encode() + payload
        kind = [("WARC-Type", "response")]
    else:
        block = head + b"\r\n"
        kind = [
            ("WARC-Type", "revisit"),
            ("WARC-Profile", _REVISIT),
            ("WARC-Refers-To", record_id(refers, digest)),
            ("X-Refers-To-Page-ID", str(refers)),
        ]
    block_digest = ("WARC-Block-Digest", f"sha1:{digest_of(block)}")
    return _record([*kind, *common, block_digest], block)


class Archive:
    """One file under a temporary name; every record is a gzip member of its own."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.fs, self.folder = fs, folder
        self.name = f".tmp-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.size = self.records = 0
        self.first = self.last = None
        self.sum = hashlib.sha256()
        info = b"software: pollweave\r\nformat: WARC File Format 1.1\r\n"
        self.add(None, _record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE),
                                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, 'info')}>"),
                                ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def add(self, key, record: bytes) -> None:
        packed = _gzip(record)
        self.out.write(packed)
        self.sum.update(packed)
        self.size += len(packed)
        self.records += 1
        self.last = key
        self.first = key if self.records == 1 else self.first

    def close(self, part: int, number: int) -> dict:
        self.out.close()
        text = lambda x: None if x is None else str(x)
        return {
            "temporary": [self.name], "file": [f"part-{part:06d}-{number:05d}.warc.gz"],
            "records": [self.records], "bytes": [self.size], "sha256": [self.sum.hexdigest()],
            "first_key": [text(self.first)], "last_key": [text(self.last)],
        }


_MANIFEST = (
    "temporary string, file string, records bigint, bytes bigint, sha256 string, "
    "first_key string, last_key string")


def write(
    pages: DataFrame,
    folder: str | None = None,
    file_bytes: int = FILE_BYTES,
    least_revisit: int = LEAST_REVISIT,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> tuple[str, DataFrame]:
    """Write a record per row in order of key; the folder and the committed manifest.

    Of rows with one payload (UTF-8, null: empty) of at least ``least_revisit`` bytes the
    row of the largest key is the response and the others are revisits of it; all other
    rows are responses. A null key is never referred to: rows of null keys alone are all
    responses. Rows repeated with key and payload are one
    response and revisits of it.

    Keys and digests are written once and joined by digest; the entries of rows that share
    a payload then go with the rows through one range partitioning by key and digest. In
    each sorted task an entry stands before the rows it marks, so payloads are shuffled
    once, however many copies there are. Files roll when
    their compressed size reaches ``file_bytes``. Tasks write under temporary names and
    report them; only what the written manifest lists is renamed, so files of lost
    attempts never count, and renaming again does nothing. Same rows, same partitioning:
    same bytes. An empty table has an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    source = pages.select(
        F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"),
        body.alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn(
        "size", F.octet_length("payload").cast("bigint"))
    narrow = staged(
        source.select("key", "digest", "size").where(F.col("size") >= least_revisit), "digests")
    owners = (
        narrow.groupBy("digest")
        .agg(F.max("key").alias("refers"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    entries = staged(
        narrow.join(owners, "digest").groupBy("key", "digest").agg(
            F.first("refers").alias("refers"), F.first("size").alias("size")),
        "revisits")
    marks = entries.select(
        "key", "digest", "size", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "refers", F.lit(0).alias("row"))
    # One row of an owner's key stays the response: the first in its sorted task.
    rows = source.select(
        "key", "digest", "size", "url", "payload", F.lit(None).cast("bigint").alias("refers"),
        F.lit(1).alias("row"))
    dealt = marks.unionByName(rows).repartitionByRange("key", "digest").sortWithinPartitions(
        "key", "digest", "row", "url")

    def function(batches):
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        part, number, archive = TaskContext.get().partitionId(), 0, None
        mark, answered = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["key"], row["digest"])
                if row["row"] == 0:
                    mark = (own, row["refers"])
                    continue
                refers = mark[1] if mark and mark[0] == own else None
                if refers is not None and refers == row["key"] and answered != own:
                    refers, answered = None, own
                archive = archive or Archive(fs, path)
                digest = base64.b32encode(row["digest"]).decode()
                payload = row["payload"] if refers is None else b""
                archive.add(row["key"], page_record(
                    row["key"], row["url"], payload, row["size"], digest, refers))
                if archive.size >= file_bytes:
                    yield archive.close(part, number)
                    archive, number = None, number + 1
        if archive:
            yield archive.close(part, number)

    return folder, commit(spark, folder, staged(arrow_map(dealt, function, _MANIFEST), "warc-files"))


def commit(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Rename the listed files and write the manifest beside them; both may be repeated."""

    def function(batches):
        fs, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{path}/{row['temporary']}", f"{path}/{row['file']}"
                if fs.get_file_info(new).type == pafs.FileType.NotFound:
                    fs.move(old, new)
                if fs.get_file_info(new).size != row["bytes"]:
                    raise ValueError(f"{row['file']} is not what the manifest says")
            yield {f.name: batch.column(f.name) for f in batch.schema}

    target = f"{folder}/manifest.parquet"
    arrow_map(files.repartition("file"), function, _MANIFEST).drop("temporary").write.mode(
        "overwrite").parquet(target)
    return spark.read.parquet(target)


def members(stream, size: int = 1 << 20):
    """The gzip members of a stream, one after the other; only one is held."""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        data = stream.read(size)
        if not data:
            if parts or unpack.unconsumed_tail:
                raise ValueError("the last record is cut off")
            return
        while data:
            parts.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(parts)
            data, parts = unpack.unused_data, []
            unpack = zlib.decompressobj(31)


def parsed(record: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record, its length and block digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                   for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    expected = headers.get("WARC-Block-Digest")
    if expected and expected != f"sha1:{digest_of(block)}":
        raise ValueError("a block differs from its digest")
    return headers, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record: key, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Files are read front to back, one record at a time; a response's payload is checked
    against its digest, a revisit has none (null).
    """

    def rows(path, fs):
        with fs.open_input_stream(path, compression=None) as stream:
            for record in members(stream):
                headers, block = parsed(record)
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                payload = None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if digest_of(payload) != digest:
                        raise ValueError("a payload differs from its digest")
                number = lambda name: int(headers[name]) if headers.get(name) else None
                yield (number("X-Page-ID"), headers["WARC-Target-URI"],
                       len(payload) if payload is not None else number("X-Payload-Length"),
                       digest, kind, number("X-Refers-To-Page-ID"), payload)

    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def function(batches):
        fs, path = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                for row in rows(f"{path}/{name}", fs):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= 4 << 20:
                        yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
                        held, size = [], 0
                if held:
                    yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))

    return arrow_map(
        manifest.select("file").repartition("file"), function,
        "key bigint, url string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint, payload binary")
