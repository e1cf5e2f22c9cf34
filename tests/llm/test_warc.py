import base64
import gzip
import hashlib
import os

import brute
import pytest
from pollweave.llm import queries, warc


def expected(rows, least=0):
    owner = {}
    for key, html in rows:
        if key is not None:
            owner[html or ""] = max(key, owner.get(html or "", key))
    out, answered = [], set()
    for key, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = owner.get(html or "")
        response = len(body) < least or own is None or (key == own and (html or "") not in answered)
        if response and key == own:
            answered.add(html or "")
        out.append((key, len(body), digest, "response" if response else "revisit",
                    None if response else own))
    return sorted(out, key=brute.key)


def test_query_equals_brute_force(llm):
    pages = list(brute.read("pages")[["page_id", "html"]].itertuples(index=False))
    assert brute.rows(queries.op4_warc(llm, brute.SMALL)) == expected(pages)


ROWS = [
    (1, "http://a/é x\r\nb", "<p>same</p>"), (9, "u", "<p>same</p>"), (9, "u", "<p>same</p>"),
    (5, None, "<p>same</p>"), (2, "u", None), (3, "u", ""), (4, "u", "a\r\n\r\nb\x00 é"),
    (None, "u", "<p>same</p>"), (None, "u", "alone"), (None, "v", "alone"), (6, "u", "z" * 300_000),
    (6, "u", "other of the same key"),
] + [(n, f"u{n}", f"<p>{n % 7}</p>") for n in range(20, 90)]


@pytest.mark.parametrize("least", [0, 9])
def test_edges_and_round_trip(llm, least):
    df = llm.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, size int")
    folder, manifest = warc.write(df, file_bytes=2500, least_revisit=least)
    found = warc.read(manifest, folder)
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert brute.rows(found.select(*names)) == expected([(k, h) for k, _, h in ROWS], least)
    bodies = {r.payload_digest: r.payload for r in found.collect() if r.payload is not None}
    for _, _, html in ROWS:
        body = (html or "").encode()
        assert bodies[base64.b32encode(hashlib.sha1(body).digest()).decode()] == body
    path = folder.removeprefix("file:")
    listed = {r.file: r for r in manifest.collect()}
    assert len(listed) > 2
    assert {f for f in os.listdir(path) if not f.startswith("manifest")} == set(listed)
    keys = []
    for name in sorted(listed):
        raw = open(f"{path}/{name}", "rb").read()
        assert len(raw) == listed[name].bytes
        assert hashlib.sha256(raw).hexdigest() == listed[name].sha256
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == listed[name].records + 1
        keys += [(listed[name].first_key, listed[name].last_key)]
    flat = [int(k) for pair in keys for k in pair if k is not None]
    assert flat == sorted(flat)


def test_same_rows_same_bytes_and_repeated_commit(llm):
    df = llm.createDataFrame(ROWS, "page_id long, url string, html string").repartition(1)
    one, two = warc.write(df), warc.write(df)
    assert [r.sha256 for r in one[1].orderBy("file").collect()] == [
        r.sha256 for r in two[1].orderBy("file").collect()]


def test_damage_is_noticed(llm):
    df = llm.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    folder, manifest = warc.write(df)
    path = f"{folder.removeprefix('file:')}/{manifest.first().file}"
    raw = open(path, "rb").read()
    record = warc.page_record(1, "u", b"abc", 3, warc.digest_of(b"abc"), None)
    assert warc.parsed(record)[1].endswith(b"abc")
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(record.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))
    with open(path, "wb") as f:
        f.write(raw[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read(manifest, folder).collect()


def test_empty_table(llm):
    folder, manifest = warc.write(llm.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc.read(manifest, folder).count() == 0
