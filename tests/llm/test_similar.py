import random

import brute
import pytest
from pollweave.llm import components, queries, similar


def reached(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def classes(docs):
    """All pairs: (key, class, links, copies)."""
    docs = list(docs)
    words = [tuple(brute.spaced(t)) for _, t in docs]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} if len(w) > 4 else {w} for w in words]
    pairs, links = [], [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            if words[a] and words[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    root = reached(pairs, range(len(docs)))
    least = {}
    for n, (key, _) in enumerate(docs):
        if key is not None:
            least[root[n]] = min(key, least.get(root[n], key))
    return sorted(
        ((key, least.get(root[n]) if words[n] else key, links[n],
          sum(w == words[n] for w in words) if words[n] else 1)
         for n, (key, _) in enumerate(docs)), key=brute.key)


def test_query_equals_brute_force(llm):
    docs = brute.read("documents")[["doc_id", "text"]].itertuples(index=False)
    expected = classes(docs)
    found = brute.rows(queries.op6_minhash_join(llm, brute.SMALL))
    assert found == expected
    assert any(r[2] > r[3] - 1 for r in expected) and any(r[3] > 1 for r in expected)


def texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for size in (60, 300):
        base = [word() for _ in range(size)]
        for n in range(40):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(size)] = word()
            out.append(" ".join(own))
    out += [" ".join(word() for _ in range(80)) for _ in range(30)]
    out += ["a b", "a  b", "a c", "", None, "   ", "x y z u v", "x y z u v", "y z u v"]
    out += ["tick " * 9000, "tick " * 20]
    return [(n if n % 17 else None, t, n) for n, t in enumerate(out)]


@pytest.mark.parametrize("block", [256, 7])
def test_edges_and_blocks(llm, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = texts()
    df = llm.createDataFrame(rows, "doc_id long, text string, n_links int")
    found = similar.classes(df)
    assert found.columns == ["key", "class_id", "n_links", "n_copies"]
    assert brute.rows(found) == classes([r[:2] for r in rows])


def test_empty_table(llm):
    assert similar.classes(llm.createDataFrame([], "doc_id long, text string")).count() == 0


def test_banding_reaches_its_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = similar.banding(similarity, 0.99)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99
        assert bands * rows <= similar.MOST_HASHES
    assert similar.banding(0.8)[1] >= 5


def test_components_of_random_edges(llm):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(400 + n, 401 + n) for n in range(60)] + [(7, 7), (None, 3), (3, None)]
    df = llm.createDataFrame(edges, "u long, v long")
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    expected = reached(real, sorted({n for e in real for n in e}))
    assert dict(components.components(df).collect()) == expected
    assert components.components(df.limit(0)).count() == 0
