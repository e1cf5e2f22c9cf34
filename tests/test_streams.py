"""Each stream over several micro-batches equals its batch twin."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from pollweave.operators import history
from pollweave.sources import state
from pollweave.streaming import jobs, keyed

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def polls(spark, tmp_path_factory):
    """The events cut into four files that arrive in time order."""
    folder = tmp_path_factory.mktemp("polls")
    events = spark.read.parquet(EVENTS).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    landed = str(folder / "landed")
    os.makedirs(landed)
    for part in range(4):
        piece = events.where(F.floor(F.col("event_id") / 250) == part)
        out = str(folder / f"part{part}")
        piece.coalesce(1).write.parquet(out)
        name = next(n for n in os.listdir(out) if n.endswith(".parquet"))
        target = os.path.join(landed, f"p{part}.parquet")
        shutil.copy(os.path.join(out, name), target)
        os.utime(target, (1_700_000_000 + part, 1_700_000_000 + part))
    return events.cache(), landed


def stream(spark, polls):
    events, folder = polls
    return jobs.read_polls(spark, folder, events.schema, files_per_trigger=1)


def same(a, b):
    def sort(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    assert sort(a) == sort(b)


def test_delta_rate(spark, polls, tmp_path):
    events, _ = polls
    folder = str(tmp_path / "job")
    start = lambda: jobs.start_delta_rate(
        stream(spark, polls), folder, ["user_id"], "ts", "value", ["event_id"])
    jobs.finish(start())
    columns = ["user_id", "ts", "event_id", "value"]
    expected = history.delta_rate(events, ["user_id"], "ts", "value", ["event_id"]).select(
        *columns, "rate")
    same(jobs.read_delta_rate(spark, folder, events, columns).select(*columns, "rate"), expected)
    assert len(os.listdir(f"{folder}/out")) == 4
    jobs.finish(start())  # a restart finds nothing new and changes nothing
    same(jobs.read_delta_rate(spark, folder, events, columns).select(*columns, "rate"), expected)


def test_late_rows_are_rated_and_change_the_rows_behind_them(spark, polls, tmp_path):
    events, _ = polls
    landed = str(tmp_path / "landed")
    os.makedirs(landed)
    # the middle arrives last
    for i, condition in enumerate(["event_id >= 700", "event_id < 300", "event_id between 300 and 699"]):
        out = str(tmp_path / f"part{i}")
        events.where(condition).coalesce(1).write.parquet(out)
        name = next(n for n in os.listdir(out) if n.endswith(".parquet"))
        shutil.copy(os.path.join(out, name), f"{landed}/p{i}.parquet")
        os.utime(f"{landed}/p{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    folder = str(tmp_path / "job")
    source = jobs.read_polls(spark, landed, events.schema, files_per_trigger=1)
    jobs.finish(jobs.start_delta_rate(source, folder, ["user_id"], "ts", "value", ["event_id"]))
    columns = ["user_id", "ts", "event_id", "value"]
    expected = history.delta_rate(events, ["user_id"], "ts", "value", ["event_id"]).select(
        *columns, "rate")
    same(jobs.read_delta_rate(spark, folder, events, columns).select(*columns, "rate"), expected)
    last = state.load(spark, f"{folder}/out", expected.schema, 2)
    assert 400 <= last.count() < 1000  # its own rows and those right behind them


def test_dedupe_forgets_nothing(spark, tmp_path):
    landed = str(tmp_path / "landed")
    os.makedirs(landed)
    for i, day in enumerate([200, 100, 0]):  # 300 days, newest file first
        out = str(tmp_path / f"part{i}")
        spark.range(day, day + 100).selectExpr(
            "id", "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as ts"
        ).coalesce(1).write.parquet(out)
        name = next(n for n in os.listdir(out) if n.endswith(".parquet"))
        shutil.copy(os.path.join(out, name), f"{landed}/p{i}.parquet")
        os.utime(f"{landed}/p{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(landed).schema
    folder = str(tmp_path / "job")
    source = jobs.read_polls(spark, landed, schema, files_per_trigger=1)
    jobs.finish(jobs.start_dedupe(jobs.union_polls(source, source), folder, ["id"]))
    found = jobs.read_dedupe(spark, folder, schema)
    assert sorted(r["id"] for r in found.collect()) == list(range(300))


def test_buckets(spark, polls, tmp_path):
    events, _ = polls
    folder = str(tmp_path / "job")
    jobs.finish(jobs.start_buckets(stream(spark, polls), folder, "ts"))
    same(jobs.read_buckets(spark, folder), jobs.count_buckets(events, "ts"))


def test_last_known(spark, polls, tmp_path):
    events, _ = polls
    folder = str(tmp_path / "job")
    order = ["ts", "event_id"]
    jobs.finish(jobs.start_last_known(stream(spark, polls), folder, ["user_id"], order, "value", 50))
    schema = "user_id bigint, value double, last_good double"
    same(jobs.read_last_known(spark, folder, schema, ["user_id"]),
         history.latest_and_good(events, ["user_id"], order, "value", 50))


def arrivals(spark, tmp_path, frames):
    """A stream that takes up one frame a batch, in their order."""
    landed = str(tmp_path / "landed")
    os.makedirs(landed)
    for i, frame in enumerate(frames):
        out = str(tmp_path / f"part{i}")
        frame.coalesce(1).write.parquet(out)
        name = next(n for n in os.listdir(out) if n.endswith(".parquet"))
        shutil.copy(os.path.join(out, name), f"{landed}/p{i}.parquet")
        os.utime(f"{landed}/p{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return jobs.read_polls(spark, landed, frames[0].schema, files_per_trigger=1)


def test_delta_rate_in_short_lists_with_shuffled_arrivals(spark, tmp_path, monkeypatch):
    """Late rows at both ends, ties, repeated rows and null values; lists are cut often."""
    import random

    draw = random.Random(4)
    rows = [(draw.choice([1, 1, 1, None]), draw.randint(0, 200) * 600, n, draw.choice([None, 1.0, 2.5, 9.0]))
            for n in range(240)]
    draw.shuffle(rows)
    ddl = "k int, s long, id long, value double"
    events = spark.createDataFrame(rows, ddl).selectExpr(
        "k", "timestamp_seconds(s) as ts", "id", "value")
    frames = [
        spark.createDataFrame(part, ddl).selectExpr("k", "timestamp_seconds(s) as ts", "id", "value")
        for part in (rows[:5], rows[5:90], rows[90:95], rows[60:170], rows[170:])]
    monkeypatch.setattr(keyed.previous_rows, "__defaults__", (6,))
    folder = str(tmp_path / "job")
    jobs.finish(jobs.start_delta_rate(
        arrivals(spark, tmp_path, frames), folder, ["k"], "ts", "value", ["id"]))
    columns = ["k", "ts", "id", "value"]
    expected = history.delta_rate(events, ["k"], "ts", "value", ["id"]).select(*columns, "rate")
    same(jobs.read_delta_rate(spark, folder, events, columns).select(*columns, "rate"), expected)
    # A batch writes its own rows and those right behind them, not the whole key.
    assert state.load(spark, f"{folder}/out", expected.schema, 2).count() <= 10


def test_snapshots_bound_what_readers_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FOLDED", 3)
    folder = str(tmp_path / "job")
    frames = [spark.range(5).selectExpr(
        "id as k", f"timestamp_seconds(id * 100 + {n}) as ts", f"cast({n} * id as double) as v")
        for n in range(8)]
    polls = arrivals(spark, tmp_path, frames)
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame)
    jobs.finish(jobs.start_buckets(polls, f"{folder}/buckets", "ts"))
    same(jobs.read_buckets(spark, f"{folder}/buckets"), jobs.count_buckets(everything, "ts"))
    jobs.finish(jobs.start_last_known(polls, f"{folder}/known", ["k"], ["ts"], "v", 4))
    schema = "k bigint, v double, last_good double"
    same(jobs.read_last_known(spark, f"{folder}/known", schema, ["k"]),
         history.latest_and_good(everything, ["k"], ["ts"], "v", 4))
    for name in ("buckets", "known"):
        assert state.versions(spark, f"{folder}/{name}/snapshot") == [2, 5]
        shutil.rmtree(f"{folder}/{name}/out/version=4")  # older versions are not needed any more
    same(jobs.read_buckets(spark, f"{folder}/buckets"), jobs.count_buckets(everything, "ts"))


def test_buckets_keep_no_state(spark, polls, tmp_path):
    folder = str(tmp_path / "job")
    query = jobs.start_buckets(stream(spark, polls), folder, "ts")
    jobs.finish(query)
    assert all(not p.stateOperators for p in query.recentProgress)


def test_dedupe(spark, polls, tmp_path):
    events, _ = polls
    folder = str(tmp_path / "job")
    twice = jobs.union_polls(stream(spark, polls), stream(spark, polls))
    jobs.finish(jobs.start_dedupe(twice, folder, ["event_id"]))
    same(jobs.read_dedupe(spark, folder, events.schema), events)


def test_short_keys_share_lists(spark, tmp_path, monkeypatch):
    """Neighbours in a list may be rows of other keys; the state has lists, not keys."""
    monkeypatch.setattr(keyed, "BUCKETS", 4)
    rows = [(f"k{n % 150}" if n % 150 else None, n * 7919 % 1000, n, n % 7 / 2) for n in range(600)]
    ddl = "k string, s long, id long, value double"
    events = spark.createDataFrame(rows, ddl).selectExpr(
        "k", "timestamp_seconds(s) as ts", "id", "value")
    frames = [events.where(f"id % 3 = {n}") for n in range(3)]
    folder = str(tmp_path / "job")
    query = jobs.start_delta_rate(
        arrivals(spark, tmp_path, frames), folder, ["k"], "ts", "value", ["id"])
    jobs.finish(query)
    columns = ["k", "ts", "id", "value"]
    expected = history.delta_rate(events, ["k"], "ts", "value", ["id"]).select(*columns, "rate")
    same(jobs.read_delta_rate(spark, folder, events, columns).select(*columns, "rate"), expected)
    stored = query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert 0 < stored < 50  # 150 keys
