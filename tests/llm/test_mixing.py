import random
from collections import Counter, defaultdict

import brute
import compare
import duckdb
import pytest

from pollweave.llm import checks, mixing, queries

SCHEMA = "doc_id long, source string, text string, g string, start long, shift string"


def save(llm, tmp_path, rows):
    df = llm.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(
        f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con


def words(count):
    return " ".join(["w"] * count)


def corpora():
    draw = random.Random(3)
    hot = [(i, "hot", words(draw.randint(0, 400))) for i in range(120)]
    small = [(i, draw.choice(["a", "b", "\U00010000", "￿", None, ""]), words(i % 40))
             for i in range(200, 260)]
    yield "hot source, ties and nulls", [
        *hot, *small, (None, "hot", "x y"), (5, "hot", None), (5, "a", words(30_000)),
        (9, "nulls", None), (10, "empty", ""), (11, "empty", " \n"), (7, "b", "u v"),
        (7, "b", "u v"), (7, "b", "s t u")]
    yield "many small sources", [
        (i, f"s{draw.randint(0, 80)}", words(draw.randint(0, 60))) for i in range(300)]
    yield "sources of one word", [(i, f"s{i}", "w") for i in range(50)]
    yield "one source", [(i, "s", words(i)) for i in range(40)]
    yield "no word", [(1, "s", ""), (2, "t", None)]
    yield "no row", []


@pytest.mark.parametrize("rows", [pytest.param(r, id=n) for n, r in corpora()])
def test_query_equals_ranked_quotients(llm, tmp_path, rows):
    con = save(llm, tmp_path, rows)
    df = queries.op13_sainte_lague(llm, str(tmp_path))
    _, found = compare.spark_rows(df)
    assert found == compare.sql_rows(con, checks.MIX)[1]
    for r in df.collect():
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6


def test_sources_come_near_their_targets(llm):
    rows = queries.op13_sainte_lague(llm, brute.SMALL).collect()
    taken, target, source = Counter(), {}, {}
    docs = dict(brute.read("documents")[["doc_id", "source"]].itertuples(index=False))
    for r in rows:
        taken[docs[r.doc_id]] += r.taken
        target[docs[r.doc_id]], source[docs[r.doc_id]] = r.target, r.source_size
    assert abs(sum(target.values()) - sum(source.values())) < 1
    for s in target:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK * 1.5, s


def targets(sizes, weights, repeats=3):
    """Share, stop, share the excess again."""
    names = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in stopped)
        heavy = sum(weight[s] for s in names if s not in stopped)
        shares = {s: left * weight[s] / heavy for s in names if s not in stopped}
        above = {s for s in shares if shares[s] > repeats * sizes[s]}
        if not above:
            return {s: shares.get(s, repeats * sizes[s]) for s in names}
        stopped |= above


def test_targets_equal_repeated_sharing(llm):
    draw = random.Random(8)
    for _ in range(3):
        sizes = {f"s{i:03}": int(10 ** draw.uniform(0, 6)) for i in range(40)}
        df = mixing.staged(
            llm.createDataFrame(list(sizes.items()), "g string, source_size long"), "sizes")
        found = {r.g: r.target for r in mixing.targets(df, [1, 2, 3]).collect()}
        assert found == pytest.approx(targets(sizes, [1, 2, 3]))


def test_schedule_holds_the_taken_words(llm):
    docs = llm.read.parquet(f"{brute.SMALL}/documents.parquet")
    mixed = mixing.mix(docs, [1, 2, 3]).cache()
    taken = Counter()
    seats, shards = defaultdict(set), Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {r.key: r["size"] for r in mixed.collect()}
    for r in mixing.schedule(mixed).collect():
        taken[r.key] += r.words
        assert 0 <= r.first_word and r.first_word + r.words <= sizes[r.key]
        seats[source[r.key]].add(r.seat)
        shards[r.shard] += r.words
    assert {r.key: r.taken for r in mixed.collect()} == {k: taken[k] for k in sizes}
    assert all(s == set(range(len(s))) for s in seats.values())
    assert set(shards) == set(range(mixing.SHARDS))
    assert max(shards.values()) - min(shards.values()) < 0.01 * sum(shards.values())
