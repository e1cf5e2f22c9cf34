"""The map job on a hand-made map, and the table documents."""

import json

import pytest
from pyspark.sql import functions as F

from pollweave.operators import network, shaping
from pollweave.plans import atlas
from pollweave.sources import documents as docs
from pollweave.sources import health

MAP = {
    "systems": [
        {"name": "甲", "name_en": "First",
         "planets": [{"en": "Alpha", "cn": "阿"}, {"en": "Beta"}, {"en": "Extra", "cn": "附"}]},
        {"name": "寂域", "name_en": "The Void", "planets": [{"en": "Gone", "cn": "无"}, {"en": ""}]},
    ],
    "planets": {
        "ALPHA": {"ID": 1, "cn": "x", "system": "other", "position": {"x": 0.5, "y": -0.5}},
        "BETA": {"ID": 2, "cn": "", "position": {"x": -1, "y": 1}},
        "GONE": {"ID": 3},
        "DELTA": {"ID": 4, "cn": "德", "sector": "丁", "position": {"x": 0, "y": 0}},
    },
}
WAYPOINTS = {"waypoints": {"1": [2, 3, 4], "2": [1], "4": [2, 99], "3": [3]}}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, body in (("map", MAP), ("way", WAYPOINTS)):
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1), encoding="utf-8")
    chart = docs.read_table(spark, str(folder / "map.json"), docs.ATLAS)
    waypoints = docs.read_table(spark, str(folder / "way.json"), docs.WAYPOINTS)
    entities = spark.createDataFrame(
        [(10, "Alpha", "Humans", 50, 100, 7, 0.0), (11, "ALPHA", "None", 1, 1, 1, 1.0),
         (12, "beta", "", 0, 0, 0, 0.0), (13, "extra", "Terminids", 5, 5, 5, 1.5)],
        "entity_id bigint, name string, owner string, health bigint, max_health bigint, "
        "players bigint, resistance double",
    )
    contests = spark.createDataFrame(
        [(10, 1, "defense", "Humans"), (10, 0, "", "Terminids"), (13, 2, None, None)],
        "entity_id bigint, seq int, contest_class string, faction string",
    )
    return atlas.build(chart, waypoints, entities, contests)


def test_nodes(built):
    nodes = {r["name_en"]: r.asDict() for r in built.nodes.collect()}
    assert sorted(nodes) == ["ALPHA", "BETA", "DELTA", "Extra", "GONE"]
    alpha = nodes["ALPHA"]
    # The list names it; of two statuses of that name the lower id counts.
    assert alpha["name"] == "阿" and alpha["sector"] == "甲" and alpha["sector_en"] == "First"
    assert alpha["owner"] == "Humans" and alpha["players"] == 7 and alpha["id"] == 1
    # The first contest counts; its empty class reads as the default.
    assert alpha["is_contested"] and alpha["contest_type"] == "liberation"
    assert alpha["faction"] == "Terminids"
    beta = nodes["BETA"]
    assert (beta["owner"], beta["health"], beta["max_health"]) == ("None", 0, 1)
    assert beta["name"] == "Beta" and not beta["is_contested"] and beta["contest_type"] is None
    assert nodes["DELTA"]["name"] == "德" and nodes["DELTA"]["sector"] == "丁"
    extra = nodes["Extra"]
    assert extra["id"] == 13 and extra["x"] is None and extra["contest_type"] == "liberation"
    assert nodes["GONE"]["layer"] == "void" and nodes["GONE"]["x"] is None
    assert {n["layer"] for k, n in nodes.items() if k != "GONE"} == {"main"}


def test_lines_and_links(built):
    lines = sorted(tuple(r) for r in built.supply_lines.collect())
    assert lines == [("main", 1, 2), ("main", 1, 4), ("main", 2, 4), ("void", 3, 3)]
    links = sorted(tuple(r) for r in built.links.select("src", "dst", "layer", "rate").collect())
    assert links == [(1, 1, "main", 1.0), (13, 13, "main", 1.0)]
    counts = {r["layer"]: tuple(r) for r in atlas.layer_counts(built).collect()}
    assert counts == {"main": ("main", 4, 1, 2), "void": ("void", 1, 1, 0)}


def test_member_info(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps(MAP), encoding="utf-8")
    info = atlas.member_info(docs.read_table(spark, str(tmp_path / "map.json"), docs.ATLAS))
    found = {r["name"]: r.asDict() for r in info.collect()}
    # Exact names: "Alpha" of the list and "ALPHA" of the map are two entries.
    assert found["ALPHA"]["id"] == 1 and found["ALPHA"]["sector"] == "other"
    assert found["Alpha"]["id"] is None and found["Alpha"]["sector"] == "甲"
    assert found["BETA"]["local_name"] == "BETA" and found["GONE"]["sector"] == ""


def test_names_without_an_entry(spark):
    index = spark.createDataFrame([("A", "甲", "s", "S")],
                                  "name_key string, local_name string, sector string, sector_en string")
    names = spark.createDataFrame([("a",), ("Z",), ("",), (None,)], "name string")
    shown = {r["name"]: (r["shown_name"], r["shown_sector"])
             for r in network.resolve_names(names, "name", index).collect()}
    assert shown == {"a": ("甲", "s"), "Z": ("Z", ""), "": ("未知", ""), None: ("未知", "")}


def test_projection(built):
    placed = atlas.projected(built.nodes, 1200, 700).where(F.col("name_en") == "BETA").first()
    assert (placed["px"], placed["py"]) == (60.0, 60.0)


def test_static_tables(spark, tmp_path):
    bodies = {
        "names": ({"0": "a", "7": "b"}, docs.NAMES),
        "taxonomy": ({"categories": [{"name": "n", "name_en": "e", "entries": [
            {"key": "k", "name": "k", "cn": "c", "desc": "d", "effect_ids": [3, 4]}]}]}, docs.TAXONOMY),
        "equipment": ([{"id": "x", "name": "X", "type": "t", "stats": [1, 2, 3, 4], "bonus": 0,
                        "subtag": []}], docs.EQUIPMENT),
        "effects": ({"9": {"galacticEffectId": 9, "name": "N", "description": "D"}}, docs.EFFECTS),
        "station": ({"9": {"name": "N", "cn": "c", "cn_full": "f"}}, docs.STATION_EFFECTS),
    }
    read = {}
    for name, (body, kind) in bodies.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body, indent=1), encoding="utf-8")
        read[name] = docs.read_table(spark, str(path), kind)
    names = shaping.explode_map(read["names"], F.col("doc")).collect()
    assert sorted(map(tuple, names)) == [("0", "a"), ("7", "b")]
    effects = shaping.explode_map(read["effects"], F.col("doc")).select(
        F.col("entry_key").cast("bigint"), "entry_value.name").first()
    assert tuple(effects) == (9, "N")
    assert shaping.explode_map(read["station"], F.col("doc")).first()["entry_value"]["cn_full"] == "f"
    categories = shaping.explode_items(read["taxonomy"], F.col("doc.categories"))
    entries = shaping.explode_items(categories, F.col("entries"), "name_en")
    ids = shaping.explode_items(entries, F.col("effect_ids"), "name_en", "key").collect()
    assert [tuple(r) for r in ids] == [("e", "k", 0, 3), ("e", "k", 1, 4)]
    gear = shaping.explode_items(read["equipment"], F.col("doc")).first()
    assert gear["id"] == "x" and gear["stats"] == [1, 2, 3, 4]


def test_missing_and_defective_tables(spark, tmp_path):
    missing = docs.read_table(spark, str(tmp_path / "none.json"), docs.NAMES)
    assert missing.count() == 0 and missing.schema["doc"].dataType.typeName() == "map"
    (tmp_path / "bad.json").write_text("{oops", encoding="utf-8")
    assert docs.read_table(spark, str(tmp_path / "bad.json"), docs.ATLAS).count() == 0


def test_sources_that_fail(spark):
    full = spark.range(3)
    empty = full.where("id < 0")
    report = {r["source"]: tuple(r)[1:] for r in health.report({"a": full, "b": empty}).collect()}
    assert report == {"a": (True, 3), "b": (False, 0)}
    assert list(health.require_any({"b": empty, "a": full})) == ["a"]
    with pytest.raises(RuntimeError):
        health.require_any({"b": empty})


def test_order_of_many_systems_and_of_map_entries(spark, tmp_path):
    many = {
        "systems": [{"name": f"s{n}", "planets": [{"en": "Same", "cn": str(n)}]} for n in range(2100)],
        "planets": {"Twin": {"ID": 1, "cn": "first"}, "TWIN": {"ID": 2, "cn": "second"}},
    }
    (tmp_path / "map.json").write_text(json.dumps(many), encoding="utf-8")
    chart = docs.read_table(spark, str(tmp_path / "map.json"), docs.ATLAS)
    nested, keyed = atlas.nested_members(chart), atlas.keyed_members(chart)
    assert nested.select("seq").distinct().count() == 2100
    index = {r["name_key"]: r["local_name"] for r in network.name_index(
        nested.drop("id", "x", "y"), keyed.drop("id", "x", "y")).collect()}
    assert index == {"SAME": "2099", "TWIN": "first"}
