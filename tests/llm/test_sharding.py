import math
import zlib
from collections import Counter

import brute
import pytest
import xxhash
from pollweave.llm import queries, sharding


def test_query_follows_the_law(llm):
    docs = brute.read("documents")
    rows = queries.op1_rendezvous(llm, brute.SMALL).collect()
    texts = {d: (t or "").encode() for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "key" and 0 <= r.shard < 40
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def winner(key, weights):
    """The shard of the largest ln(u) / weight, the lower one of equals."""
    best = None
    for n, weight in enumerate(weights):
        if weight > 0:
            seed = xxhash.xxh64_intdigest(("\0" if key is None else str(key)).encode(), 42)
            draw = xxhash.xxh64_intdigest(f"shard {n}".encode(), seed) >> 11
            score = math.log((draw + 0.5) / 2.0**53) / weight
            if best is None or score > best[0]:
                best = score, n
    return best[1]


def test_shards_equal_brute_force(llm):
    rows = queries.op1_rendezvous(llm, brute.SMALL).collect()
    for r in rows:
        assert r.shard == winner(r.doc_id, [1.0] * 40)
        assert r.grown_shard == winner(r.doc_id, [1.0] * 41)
    weights = [1.0, 0.0, 2.5, 0.25]
    df = llm.createDataFrame([(k, "x") for k in (None, *range(300))], "doc_id long, text string")
    for r in sharding.assign(df, weights).collect():
        assert r.shard == winner(r.key, weights)


def shards(llm, count, weights):
    df = llm.range(count).selectExpr("id as doc_id", "cast(null as string) as text")
    return {r.key: r for r in sharding.assign(df, weights).collect()}


def test_one_more_shard_takes_rows_only_into_itself(llm):
    small, large = shards(llm, 4000, [1.0] * 10), shards(llm, 4000, [1.0] * 11)
    moved = [k for k in small if small[k].shard != large[k].shard]
    assert all(large[k].shard == 10 for k in moved) and 250 < len(moved) < 480
    assert all(small[k].grown_shard == large[k].shard for k in small)


def test_weights_decide_the_shares(llm):
    found = Counter(r.shard for r in shards(llm, 8000, [1.0, 3.0, 0.0, 4.0]).values())
    assert found[2] == 0
    assert abs(found[0] - 1000) < 150 and abs(found[1] - 3000) < 250 and abs(found[3] - 4000) < 250
    without = shards(llm, 2000, [1.0, 3.0])
    with_more = shards(llm, 2000, [1.0, 3.0, 2.0])
    assert all(with_more[k].shard in (without[k].shard, 2) for k in without)


def test_edges(llm):
    rows = [(None, "a", 1)] * 3 + [(5, None, 1), (5, "", 1), (5, "é", 1)] + [(7, "x", 1)] * 400
    df = llm.createDataFrame(rows, "doc_id long, text string, shard int")
    found = sharding.assign(df, [1.0] * 4).collect()
    assert len(found) == len(rows)
    assert len({r.shard for r in found if r.key == 7}) == 1
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.size for r in found if r.key == 5) == [16, 16, 18]
    assert sharding.assign(df.limit(0), [1.0]).count() == 0
    for wrong in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.assign(df, wrong)
