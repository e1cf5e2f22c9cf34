import hashlib
import random
import zlib

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pollweave.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(*fields):
    out = ""
    for f in fields:
        if f is None:
            out += "-"
        else:
            out += f"{len(str(f).encode())}:{f}"
    return h(out)


def tree(digests):
    """The root and, per leaf, the levels (left siblings, right siblings) up to it."""
    levels, now = [], list(digests)
    while len(now) > 1:
        levels.append(now)
        now = [h("".join(now[i : i + 3])) for i in range(0, len(now), 3)]
    proofs = []
    for i in range(len(digests)):
        proof = []
        for nodes in levels:
            run = nodes[i - i % 3 : i - i % 3 + 3]
            proof.append((run[: i % 3], run[i % 3 + 1 :]))
            i //= 3
        proofs.append(proof)
    return now[0], proofs


def expected(docs):
    """Rows of op11 for (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append((d[0], leaf(*d), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in groups[g]]) for g in order]
    root, upper = tree([t[0] for t in trees])
    rows = []
    for g, (subroot, proofs), above in zip(order, trees, upper, strict=True):
        for (doc_id, own, d), proof in zip(groups[g], proofs, strict=True):
            path = proof + above
            digest = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = d[4].replace("\n", "") if d[4] is not None else None
                digest = leaf(*d[:4], text)
            for left, right in path:
                digest = h("".join(left) + digest + "".join(right))
            joined = "".join("".join(left + right) for left, right in path)
            rows.append((doc_id, own, subroot, root, h(joined), digest, digest == root))
    return sorted(rows, key=brute.key)


def op11(llm, folder):
    return brute.rows(queries.op11_time_forward(llm, folder).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


def test_query_equals_plain_trees(llm):
    docs = brute.read("documents")
    fields = docs[["doc_id", "source", "lang", "n_chars", "text"]]
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in fields.itertuples(index=False)]
    found = op11(llm, brute.SMALL)
    assert found == expected(rows)
    assert {True, False} == {r[-1] for r in found}


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, n string"


@pytest.mark.parametrize("block", [(1, 3), (2, 9), (6, 729)])
def test_hot_group_nulls_ties_and_extra_columns(llm, tmp_path, monkeypatch, block):
    monkeypatch.setattr(merkle, "LEVELS", block[0])
    monkeypatch.setattr(merkle, "BLOCK", block[1])
    draw = random.Random(5)
    rows = [(i, "hot", "en", i, f"a\nb {i}" * (i % 3)) for i in range(85)]
    rows += [(i, draw.choice(["", "", "\U00010000", "b", None]), None, None, None)
             for i in range(100, 128)]
    rows += [(None, "hot", None, 3, "x"), (7, "hot", "de", 3, "x\n"), (7, "hot", "de", 3, "x\n"),
             (7, None, "de", 3, ""), (500, "alone", "de", 3, "y"), (9, "three", "a", 0, "z\n"),
             (10, "three", "a", 0, "z\n"), (11, "three", "a", 0, "\n" * 5000)]
    df = llm.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    assert op11(llm, str(tmp_path)) == expected(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 9, 10])
def test_one_group_of_few_rows(llm, tmp_path, count):
    rows = [(i, "s", "en", 1, "t\n") for i in range(count)]
    llm.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(
        str(tmp_path / "documents.parquet"))
    assert op11(llm, str(tmp_path)) == (expected(rows) if rows else [])


def test_proofs_lead_from_leaf_to_root(llm):
    df = llm.range(2000).selectExpr("id as doc_id", "'s' || (id % 2) as source")
    found = merkle.manifest(df, F.sha2(F.col("doc_id").cast("string"), 256))
    folded = found.select("root", merkle.folded(F.col("leaf"), F.col("proof")).alias("again"))
    assert folded.where("root = again").count() == 2000 and folded.distinct().count() == 1
