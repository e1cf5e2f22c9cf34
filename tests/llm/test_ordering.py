import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pollweave.llm import common, ordering


def test_filter_lets_all_keys_through_and_few_others(llm):
    keys = llm.range(0, 70_000, 7).select(F.col("id").alias("marked"))
    passes = common.likely(keys, "marked")
    found = {r.id for r in llm.range(70_000).where(passes(F.col("id"))).collect()}
    assert set(range(0, 70_000, 7)) <= found and len(found) < 12_000
    assert llm.range(100).where(common.likely(keys.limit(0), "marked")(F.col("id"))).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_running_sums_and_numbers(llm, rows):
    draw = random.Random(rows)
    data = [(draw.choice(["hot", "hot", "a", None]), draw.randint(0, 9), n) for n in range(rows)]
    df = common.staged(llm.createDataFrame(data, "g string, k int, v long"), "rows")
    places = ordering.ranged(df, ["g", "k", "v"], "order")
    facts = llm.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "g string, fact int")
    found = ordering.running(places, ["g"], F.col("v"), "before", facts).collect()
    own = {}
    for g, k, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        own[g, k, v] = sum(x for h, _, x in own if h == g)
    assert {(r.g, r.k, r.v): r.before for r in found} == own
    assert all(r.fact == {"hot": 1, "a": 2, None: 3}[r.g] for r in found)
    numbers = {}
    for r in ordering.numbered(df, ["g"], ["k", "v"], "n").collect():
        numbers.setdefault(r.g, []).append((r.n, r.k, r.v))
    for group in numbers.values():
        assert [n for n, _, _ in sorted(group)] == list(range(len(group)))
        assert [x[1:] for x in sorted(group)] == sorted(x[1:] for x in group)


def test_whole_groups_cut_between_batches():
    values = [(g, n) for g in range(30) for n in range(g % 7 + 1)]
    batches = [
        pa.RecordBatch.from_pydict({"g": [g for g, _ in part], "n": [n for _, n in part]})
        for part in (values[i : i + 5] for i in range(0, len(values), 5))]
    batches.insert(3, batches[0].slice(0, 0))
    seen = []
    for rows in ordering.whole_groups(batches, ["g"]):
        cuts = ordering.starts(rows, ["g"])
        groups = rows["g"].to_pylist()
        assert not seen or seen[-1][0] != groups[0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert len(set(groups[a:b])) == 1
        seen += list(zip(groups, rows["n"].to_pylist(), strict=True))
    assert seen == values
    assert not list(ordering.whole_groups([], ["g"]))
