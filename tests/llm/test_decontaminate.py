import brute
from pollweave.llm import decontaminate, queries


def found(llm, docs, items, monkeypatch=None, **options):
    docs = llm.createDataFrame(docs, "doc_id long, text string, starts int")
    items = llm.createDataFrame(items, "item_id long, text string")
    return decontaminate.find(docs, items, **options)


def digest(df):
    rows = df.selectExpr(
        "doc_id", "n_words", "starts_ as starts", "ends", "items").collect()
    return sorted(
        ((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.starts, r.ends, strict=True)),
          len(r.items), brute.sha256(",".join(sorted(r["items"]))), bool(r.starts)) for r in rows),
        key=brute.key)


def test_query_equals_brute_force(llm):
    docs = brute.read("documents")[["doc_id", "text"]].itertuples(index=False)
    items = brute.read("benchmark")[["item_id", "text"]].itertuples(index=False)
    expected = brute.contamination(docs, items)
    assert any(r[5] for r in expected)
    assert brute.rows(queries.op10_fm_index(llm, brute.SMALL)) == sorted(expected, key=brute.key)


LONG = " ".join(f"w{i}" for i in range(25))
DOCS = [
    (1, f"before {LONG} after", 7), (1, f"before {LONG} after", 7), (2, None, 7), (3, "", 7),
    (None, f"x. {LONG.upper()}!! " * 3, 7), (4, "one two ONE two, one", 7), (5, "solo", 7),
    (6, " ".join(["tick"] * 5000) + " " + LONG, 7), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x w9", 7),
    (8, "é solo É", 7),
]
ITEMS = [
    (10, LONG), (11, LONG), (9, "one two one"), (None, "two one"), (12, None), (13, "..."),
    (14, "Solo"), (15, "é"), (16, "tick " * 12),
]


def test_edges_and_clashing_names(llm):
    df = found(llm, DOCS, ITEMS)
    assert df.columns == ["doc_id", "text", "starts", "n_words", "starts_", "ends", "items"]
    expected = brute.contamination([d[:2] for d in DOCS], [(i if i else "", t) for i, t in ITEMS])
    assert digest(df) == sorted(expected, key=brute.key)


def test_blocks_and_shards_change_nothing(llm, monkeypatch):
    whole = digest(found(llm, DOCS, ITEMS))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert digest(found(llm, DOCS, ITEMS)) == whole


def test_removal_leaves_clean_text(llm):
    rows = {r.doc_id: r.text for r in found(llm, DOCS, ITEMS[:1], remove=True).collect()}
    assert rows[1] == "before  after" and rows[2] is None and rows[5] == "solo"
    again = found(llm, [(k, t, 0) for k, t in rows.items()], ITEMS[:1])
    assert not any(r.starts_ for r in again.collect())


def test_empty_tables(llm):
    assert digest(found(llm, [], ITEMS)) == []
    assert not any(r[5] for r in digest(found(llm, DOCS, [])))
