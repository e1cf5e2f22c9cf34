import random

import brute
import pytest
from pollweave.llm import queries, substrings


def removed(docs, window=50):
    docs = [(k, brute.spaced(t)) for k, t in docs]
    least = {}
    for key, words in docs:
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if key is not None:
                least[own] = min(key, least.get(own, key))
    out = []
    for key, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and least[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((key, len(words), len(gone), brute.sha256(" ".join(kept))))
    return sorted(out, key=brute.key)


def test_query_equals_brute_force(llm):
    docs = brute.read("documents")[["doc_id", "text"]].itertuples(index=False)
    expected = removed(docs)
    assert brute.rows(queries.op8_fm_index(llm, brute.SMALL)) == expected
    assert sum(0 < r[2] < r[1] for r in expected) > 1


def texts():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 75, 200)]
    out = []
    for _ in range(60):
        parts = [some(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), some(rng.randrange(60))]
        out.append("\n ".join(parts))
    out += [out[3], out[3], None, "", "  \t", "tick " * 6000, "tick " * 49, "tick " * 50]
    out += ["a b " * 400, "b a " * 100, passages[4] + " " + passages[4]]
    rows = [(n, t, 1) for n, t in enumerate(out)]
    rng.shuffle(rows)
    rows += [(None, out[5], 1), (rows[0][0], rows[0][1], 1), (rows[1][0], out[7], 1), (-4, out[9], 1)]
    return rows


@pytest.mark.parametrize("most", [20_000, 3])
def test_edges_and_hot_anchors(llm, monkeypatch, most):
    monkeypatch.setattr(substrings, "ANCHOR_ROWS", most)
    rows = texts()
    df = llm.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = substrings.repeats(df, with_text=True)
    assert brute.rows(found.select("key", "n_words", "n_removed", "kept_sha256")) == removed(
        [r[:2] for r in rows])
    for row in found.where("kept_text is not null").collect():
        assert brute.sha256(" ".join(brute.spaced(row.kept_text))) == row.kept_sha256
    assert found.where("n_removed > 0 and kept_text is null").count() == 0


def test_other_windows(llm):
    rows = [(n, f"{'x ' * n}p q r s t {'y ' * n}") for n in range(8)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for window in (3, 12):
        found = substrings.repeats(df, window=window)
        assert brute.rows(found.select("key", "n_words", "n_removed", "kept_sha256")) == removed(
            rows, window)


def test_empty_table(llm):
    assert substrings.repeats(llm.createDataFrame([], "doc_id long, text string")).count() == 0
