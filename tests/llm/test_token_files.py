import os
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pollweave.llm import encoding, queries, token_files
from tokenizers import Tokenizer


def expected(docs):
    tokenizer = Tokenizer.from_file(encoding.path())
    out, at = [], 0
    for key, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def found(df, name="key"):
    return sorted((None if r[name] is None else int(r[name]), r.start, r.n_tokens, r.ids_crc32)
                  for r in df.collect() if r[name] is not None) + [
        (None, r.start, r.n_tokens, r.ids_crc32) for r in df.where(f"{name} is null").collect()]


def test_query_equals_the_tokenizer(llm):
    docs = list(brute.read("documents")[["doc_id", "text"]].itertuples(index=False))
    df = queries.op7_perfect_hash(llm, brute.SMALL)
    assert found(df, "doc_id") == sorted(expected(docs))


ODD = [(3, "b"), (1, "a b c"), (1, "a b c"), (1, None), (2, ""), (None, "x y"), (4, "tick " * 5000)]
ODD += [(n, f"doc {n}") for n in range(10, 300)]


def test_edges_rolling_and_keyed_access(llm, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 40)
    df = llm.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, key int")
    folder, manifest = token_files.write(df)
    rows = manifest.collect()
    assert sum(r.docs for r in rows) == len(ODD)
    names = {r.file for r in rows}
    assert names <= set(os.listdir(folder.removeprefix("file:")))
    assert sorted(found(token_files.read(manifest, folder)), key=str) == sorted(expected(ODD), key=str)
    tokenizer = Tokenizer.from_file(encoding.path())
    files = [token_files.Reader(folder, n) for n in names]
    assert sum(len(f.get(99)) for f in files) == 1
    assert [x.tolist() for f in files for x in f.get(99)] == [
        tokenizer.encode("doc 99", add_special_tokens=False).ids + [2]]
    assert sum(len(f.get(1)) for f in files) == 3
    assert sum(len(f.get(None)) for f in files) == 1
    assert sum(len(f.get(12345)) for f in files) == 0
    # The manifest leads from a key to its files: no other is opened.
    for key, rows_of in ((99, 1), (1, 3), (None, 1), (12345, 0), (5, 0)):
        own = [r.file for r in token_files.holding(manifest, key).collect()]
        assert len(own) <= 1 or key == 1
        assert sum(len(token_files.Reader(folder, n).get(key)) for n in own) == rows_of


def test_rows_come_from_the_index(llm, monkeypatch):
    df = llm.createDataFrame([(n, f"doc {n} {n * 7}") for n in range(50)], "doc_id long, text string")
    folder, manifest = token_files.write(df)
    name = manifest.first().file
    file = token_files.Reader(folder, name)
    order = token_files._numbers(file)
    assert order.tolist() == list(range(len(order)))
    file.first = file.first[::-1].copy()  # an index that leads elsewhere gives other rows
    assert token_files._numbers(file).tolist() != order.tolist()


def test_files_without_a_manifest_entry_do_not_count(llm):
    df = llm.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    folder, manifest = token_files.write(df)
    with open(f"{folder.removeprefix('file:')}/ids-lost.bin", "wb") as f:
        f.write(b"half a fi")
    assert token_files.read(manifest, folder).count() == 2
    with pytest.raises(ValueError, match="whole token file"):
        with open(f"{folder.removeprefix('file:')}/ids-lost.bin", "ab") as f:
            f.write(b"x" * 100)
        token_files.Reader(folder, "ids-lost.bin")


def test_empty_table(llm):
    folder, manifest = token_files.write(llm.createDataFrame([], "doc_id long, text string"))
    assert manifest.count() == 0 and token_files.read(manifest, folder).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_hash_is_perfect_and_minimal(n):
    keys = pa.array([f"key {i}" for i in range(n)])
    hashes = token_files.key_hashes(keys)
    shifts = token_files.build(hashes)
    slots, _ = token_files.slots_of(hashes, shifts, n)
    assert sorted(slots.tolist()) == list(range(n))
    assert len(shifts) <= n // 4 + 1
