"""Versioned state tables."""

import os

from pollweave.operators import history
from pollweave.sources import state


def cache(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, top int")


def test_cache_upsert(spark, tmp_path):
    folder = str(tmp_path / "cache")
    first = state.update_cache(spark, folder, cache(spark, (1, 1000), (2, 2000)), ["id"], 1)
    assert sorted(map(tuple, first.collect())) == [(1, 1000), (2, 2000)]
    for _ in range(2):  # a repeated run replaces its own version
        second = state.update_cache(spark, folder, cache(spark, (2, 3000), (3, 5000)), ["id"], 5)
        assert sorted(map(tuple, second.collect())) == [(1, 1000), (2, 3000), (3, 5000)]


def test_a_version_writes_only_buckets_that_changed(spark, tmp_path):
    folder = str(tmp_path / "cache")
    many = spark.range(3000).selectExpr("cast(id as int) as id", "cast(id + 1000 as int) as top")
    whole = state.update_cache(spark, folder, many, ["id"], 1)
    assert whole.count() == 3000 and len(os.listdir(f"{folder}/rows/version=1")) > state.BUCKETS
    few = many.where("id < 40").selectExpr("id", "if(id < 10, -1, top) as top")
    again = state.update_cache(spark, folder, few, ["id"], 2)
    written = [n for n in os.listdir(f"{folder}/rows/version=2") if n.startswith("bucket=")]
    assert 1 <= len(written) <= 10  # ten keys changed, thirty came with what they had
    assert again.where("top = -1").count() == 10 and again.count() == 3000
    nothing = state.update_cache(spark, folder, few, ["id"], 3)
    assert nothing.count() == 3000 and not os.path.exists(f"{folder}/rows/version=3")
    # An older version can still be read, and a repeated run sees what it saw before.
    assert state.load_keyed(spark, folder, many.schema, 2).where("top = -1").count() == 0
    odd = cache(spark, (None, 5), (None, 3), (1, None))
    last = state.update_cache(spark, folder, odd, ["id"], 4)
    assert [tuple(r) for r in last.where("id is null or id = 1").orderBy("id").collect()] == [
        (None, 3), (1, None)]


def test_versions(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id int, top int"
    assert state.load(spark, folder, schema, 1).count() == 0
    assert state.load_before(spark, folder, schema, 9).count() == 0
    state.save(cache(spark, (1, 1), (2, 1)), folder, 3)
    state.save(cache(spark, (2, 7)), folder, 8)
    assert state.load_before(spark, folder, schema, 8).count() == 2
    assert state.load_before(spark, folder, schema, 3).count() == 0
    latest = state.load_latest_rows(spark, folder, schema, ["id"])
    assert sorted(map(tuple, latest.collect())) == [(1, 1), (2, 7)]


def test_last_good_value(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5000), (1, 2, 999), (2, 1, 1000), (2, 2, 1200), (3, 1, 1)],
        "id int, ts int, top int")
    out = history.latest_and_good(rows, ["id"], ["ts"], "top")
    assert sorted(map(tuple, out.select("id", "top", "last_good").collect())) == [
        (1, 999, 5000), (2, 1200, 1200), (3, 1, None)]
