"""Operators on small tables with hand-worked or brute-force results."""

import random

import pytest
from pyspark.sql import Window, functions as F

from pollweave.operators import history, network, ordered, overlay, precedence, shaping, spatial


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


# ---- one side only, conditional overlays ----


def test_assemble_keeps_one_sided_entities(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    right = spark.createDataFrame([(2, 5), (3, None)], "id int, health int")
    out = overlay.assemble(left, right, ["id"], {"name": "?", "health": 0})
    assert rows(out) == [(1, "a", 0), (2, "?", 5), (3, "?", 0)]


def test_overlay_policies(spark):
    base = spark.createDataFrame(
        [(1, 5, [1], "PLANET_1", "s", 1), (2, 5, [1], "Own", "s", 5000), (3, 5, [1], "", "s", 0)],
        "id int, players int, effects array<int>, name string, sector string, top int",
    )
    source = spark.createDataFrame(
        [(1, 0, [], "One", "x", 2000, None), (2, 9, [7], "Two", None, 9, 3),
         (4, 1, [1], "z", "z", 1, 1)],
        "id int, players int, effects array<int>, name string, sector string, top int, regen int",
    )
    out = overlay.overlay(base, source, ["id"], {
        "players": overlay.take_number, "effects": overlay.take_array,
        "name": overlay.take_if_stand_in, "sector": overlay.take_always, "top": overlay.take_below(),
        "regen": overlay.take_or_zero,
    })
    assert rows(out) == [
        (1, 5, [1], "One", "x", 2000, 0), (2, 9, [7], "Own", "s", 5000, 3),
        (3, 5, [1], "", "s", 0, None)]


def test_best_maximum(spark):
    cases = [(1, None, 7), (999, 999, 7), (999, 1000, 7), (1000, 5000, 7), (0, 999, None)]
    df = spark.createDataFrame(cases, "own int, cached int, health int")
    out = df.select(overlay.best_maximum(F.col("own"), F.col("cached"), F.col("health")).alias("m"))
    assert [r["m"] for r in out.collect()] == [7, 7, 1000, 1000, 0]


def test_a_hot_key_is_split_in_a_lookup_join(spark):
    """A key with most of the rows does not end in one task when the lookup is large."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"),
            F.xxhash64("id").alias("v"))
        lookup = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("w"))
        joined = overlay.attach(facts, lookup, ["k"], "l_")
        totals = joined.agg(F.count("l_w"), F.sum("l_w")).first()
        assert totals[0] == 60000
        rows_out = joined.collect()
        assert len(rows_out) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# ---- precedence ----


def test_by_field_takes_each_field_from_its_own_order(spark):
    a = spark.createDataFrame([(1, "", 5), (2, "a2", 0)], "id int, title string, size int")
    b = spark.createDataFrame([(1, "b1"), (3, None)], "id int, title string")
    out = precedence.by_field(
        precedence.stack({"a": a, "b": b}), ["id"], {"title": ["b", "a"], "size": ["a"]},
        {"title": F.nullif("title", F.lit("")), "size": F.nullif("size", F.lit(0))},
    )
    assert rows(out, "id", "title", "title_source", "size", "size_source") == [
        (1, "b1", "b", 5, "a"), (2, "a2", "a", None, None), (3, None, None, None, None)]


def test_whole_poll_never_mixes_sources(spark):
    a = spark.createDataFrame([(1, 10), (1, 11)], "poll int, id int")
    b = spark.createDataFrame([(1, 99), (2, 20)], "poll int, id int")
    out = precedence.whole_poll(precedence.stack({"a": a, "b": b}), ["poll"])
    assert rows(out, "poll", "id", "source") == [(1, 10, "a"), (1, 11, "a"), (2, 20, "b")]


# ---- history ----


def test_priority_dedupe(spark):
    contests = spark.createDataFrame(
        [(1, 7, "0", None), (2, 7, "defense", None), (3, 7, "defense", 1), (4, 7, "defense", 2),
         (5, 8, "0", None), (6, 8, "1", None), (7, None, "defense", 1)],
        "seq int, id int, type string, event int")
    out = history.priority_dedupe(
        contests, "id", F.col("type") == "defense", F.col("event"), F.col("seq"))
    assert rows(out, "id", "seq") == [(7, 3), (8, 5)]


@pytest.mark.parametrize("count", [287, 288, 289])
def test_retention(spark, count):
    series = spark.range(count).select(F.col("id").alias("ts"))
    kept = history.retention_tail(series, [F.desc("ts")])
    assert kept.count() == min(count, 288) and kept.agg(F.max("ts")).first()[0] == count - 1


def test_append_if_absent_drops_repeats(spark):
    store = spark.createDataFrame([(1, "s")], "ts int, v string")
    incoming = spark.createDataFrame([(1, "n"), (2, "n"), (2, "m"), (2, "n")], "ts int, v string")
    assert rows(history.append_if_absent(store, incoming, ["ts"])) == [(1, "s"), (2, "m")]


def skewed(spark, count=3000, seed=3):
    """A third of the rows under one key, some keys null, ties on ts broken by id."""
    rng = random.Random(seed)
    data = [
        (i, None if i % 50 == 0 else (0 if i % 3 == 0 else rng.randrange(1, 40)),
         rng.randrange(0, 900), rng.choice([None, round(rng.random() * 100, 2)]))
        for i in range(count)
    ]
    return spark.createDataFrame(data, "id long, k int, ts long, v double").repartition(8)


def test_hot_keys_give_the_same_rows(spark):
    df = skewed(spark).cache()
    window = Window.partitionBy("k").orderBy("ts", "id")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = df.select(
        "id", F.lag("ts").over(window), F.lag("v").over(window),
        F.last("v", ignorenulls=True).over(running))
    before = ordered.previous_values(df, ["k"], ["ts", "id"], ["ts", "v"])
    known = ordered.last_known(df, ["k"], ["ts", "id"], ["v"]).select("id", "last_v")
    found = before.join(known, "id").select("id", "prev_ts", "prev_v", "last_v")

    def key(row):
        return tuple((x is not None, x) for x in row)

    assert sorted(map(key, map(tuple, found.collect()))) == sorted(
        map(key, map(tuple, expected.collect())))


def test_hot_keys_are_cut_into_segments(spark, tmp_path):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("ts"))
    out = ordered.previous_values(df, ["k"], ["ts"], ["ts"])
    assert out.where(F.col("prev_ts") == F.col("ts") - 1).count() == 3999
    plan = out._jdf.queryExecution().toString()
    assert "_segment" in plan and "FileScan parquet" in plan


# ---- shaping ----


def test_distinct_in_order(spark):
    df = spark.createDataFrame(
        [(1, 0, 30), (1, 1, 20), (1, 2, 30), (2, 3, None), (2, 4, 5)], "k int, pos int, e int")
    out = shaping.distinct_in_order(df, ["k"], "e", F.col("pos"))
    assert rows(out) == [(1, [30, 20]), (2, [5])]


def test_keep_owned(spark):
    fresh = spark.createDataFrame([(1, "x", "lost"), (2, "y", "lost")], "k int, v string, news string")
    previous = spark.createDataFrame([(1, "kept"), (3, "gone")], "k int, news string")
    out = shaping.keep_owned(fresh, previous, ["k"], {"news": ""})
    assert rows(out, "k", "v", "news") == [(1, "x", "kept"), (2, "y", "")]


def test_first_and_present_items(spark):
    df = spark.createDataFrame([([1, None, 2],), ([],), (None,)], "a array<int>")
    out = df.select(shaping.first_item(F.col("a")), shaping.present_items(F.col("a"))).collect()
    assert [tuple(r) for r in out] == [(1, [1, 2]), (None, []), (None, [])]


# ---- network ----


def test_names_in_any_case_never_fan_out(spark):
    entities = spark.createDataFrame(
        [(5, "Twin"), (3, "TWIN"), (7, "Solo")], "entity_id int, name string")
    by_name = network.first_by_name(entities, "name", F.col("entity_id")).drop("name")
    probes = spark.createDataFrame([("twin",), ("sOLO",), ("gone",), (None,)], "name string")
    out = network.join_by_name(probes, "name", by_name)
    assert sorted(out.collect(), key=str) == sorted(
        [("twin", 3), ("sOLO", 7), ("gone", None), (None, None)], key=str)


def test_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 9), (4, 4), (2, 3)], "src int, dst int")
    assert network.edge_stats(edges).first().asDict() == {
        "sources": 4, "directed": 5, "undirected": 4, "bidirectional": 1}
    nodes = spark.createDataFrame(
        [(1, "m"), (2, "m"), (3, "v"), (4, "v")], "id int, layer string")
    assert rows(network.edges_in_layer(edges, nodes)) == [("m", 1, 2), ("v", 4, 4)]
    at_two = network.incident_edges(edges.distinct(), nodes.where("id in (2, 4)"))
    assert rows(at_two) == [(2, 1, 2), (2, 2, 1), (2, 2, 3), (4, 4, 4)]


def test_undirected_is_never_larger(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(300)]
    stats = network.edge_stats(spark.createDataFrame(pairs, "src int, dst int")).first()
    directed = set(pairs)
    both = {(a, b) for a, b in directed if a < b and (b, a) in directed}
    assert stats["directed"] == len(directed) and stats["bidirectional"] == len(both)
    assert stats["undirected"] == len(directed) - len(both)


def test_region(spark):
    df = spark.createDataFrame(
        [("THE VOID", None), ("the void", ""), (None, " 寂域 "), ("Void", "x")], "en string, cn string")
    out = df.select(network.is_region(F.col("en"), F.col("cn")).alias("r")).collect()
    assert [r["r"] for r in out] == [True, True, True, False]


# ---- geometry ----


def test_fit_to_view(spark):
    def fit(points):
        df = spark.createDataFrame(points, "px double, py double")
        return spatial.fit_to_view(spatial.bounds(df), 1200, 700).first()

    single = fit([(100.0, 50.0)])
    assert single["scale"] == 1.5 and single["offset_x"] == 450.0
    line = fit([(0.0, 10.0), (10800.0, 10.0)])
    assert line["scale"] == 0.3  # 1080 / 10800 is below the least scale
    assert fit([(None, None)]) is None
    skipped = fit([(None, None), (0.0, 0.0), (1080.0, 290.0)])
    assert skipped["scale"] == 1.0 and skipped["offset_y"] == 205.0


def test_group_bounds(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 5.0, 3.0), ("", 0.0, 0.0), (None, 9.0, 0.0)],
                               "sector string, px double, py double")
    out = spatial.group_bounds(df, F.col("sector"))
    assert rows(out) == [("a", -19.0, -18.0, 44.0, 41.0, 2), ("未知星区", -20.0, -20.0, 49.0, 40.0, 2)]


def test_screen_and_world_are_inverse(spark):
    df = spark.createDataFrame([(3.0, -4.0)], "x double, y double")
    sx, sy = spatial.to_screen(F.col("x"), F.col("y"), 2.0, 10.0, 20.0)
    out = df.select(*spatial.to_world(sx, sy, 2.0, 10.0, 20.0)).first()
    assert tuple(out) == (3.0, -4.0)


def brute_force(probes, nodes, radius):
    found = {}
    for p, x, y in probes:
        if x is None or y is None:
            continue
        near = [d for d, a, b in nodes if a is not None and b is not None
                and (x - a) * (x - a) + (y - b) * (y - b) < radius * radius]
        if near:
            found[p] = max(near)
    return found


@pytest.mark.parametrize("shape,levels", [
    ("uniform", None), ("uniform", 0), ("cluster", None), ("sorted", 2), ("edge", None),
    ("crowd", None)])
def test_radius_hit_equals_brute_force(spark, shape, levels):
    rng = random.Random(7)
    radius = 0.1
    if shape == "edge":  # probes exactly on the radius, copies, missing coordinates
        nodes = [(0, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 0.0), (3, 0.3, 0.3)]
        probes = [(0, radius, 0.0), (1, 0.099, 0.0), (2, 0.0, 0.0), (3, None, None), (4, 0.3, 0.3)]
    else:
        spread = {"uniform": 1.0, "cluster": 0.05, "sorted": 0.5, "crowd": 0.004}[shape]
        points = [(rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for _ in range(400)]
        if shape == "sorted":  # drawn from left to right: the last nodes lie on one side
            points.sort()
        nodes = [(i, x, y) for i, (x, y) in enumerate(points)]
        probes = [(i, rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for i in range(150)]
        probes += [(1000 + i, x, y) for i, x, y in nodes[:50]]
        if shape == "crowd":  # probes whose circle cuts through the crowd
            probes += [(2000 + i, radius + rng.uniform(-0.004, 0.004), 0.0) for i in range(50)]
    found = spatial.radius_hit(
        spark.createDataFrame(probes, "probe_id int, x double, y double"),
        spark.createDataFrame(nodes, "draw_order int, x double, y double"),
        radius, levels,
    )
    assert {r["probe_id"]: r["draw_order"] for r in found.collect()} == brute_force(
        probes, nodes, radius)
