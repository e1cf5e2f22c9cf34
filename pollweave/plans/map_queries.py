"""Registered queries: names, layers, edges and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollweave.functions import fixed
from pollweave.operators import network, spatial
from pollweave.sources.tables import table

WIDTH, HEIGHT = 1200.0, 700.0
HIT = 0.02


def name_index(spark, sf):
    size = F.col("p_size")
    nested = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size").select(
        F.when(size > 25, F.initcap("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(size > 10, F.col("p_brand")).otherwise("").alias("local_name"),
        F.col("p_brand").alias("sector"),
        F.lit("parts").alias("sector_en"),
        F.col("p_partkey").alias("seq"),
    )
    keyed = table(spark, sf, "documents", "doc_id", "source", "lang").select(
        F.when(F.col("lang") == "en", F.upper("source")).otherwise(F.col("source")).alias("name"),
        F.lit("").alias("local_name"),
        F.col("lang").alias("sector"),
        F.lit("").alias("sector_en"),
        F.col("doc_id").alias("seq"),
    )
    return network.name_index(nested, keyed)


NAME_INDEX = """
WITH n AS (
  SELECT p_partkey, p_brand, p_size, p_name, CASE WHEN p_size > 25 THEN
    (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w))
    ELSE p_name END AS name FROM part
), entries AS (
  SELECT name, CASE WHEN p_size > 10 THEN p_brand ELSE name END AS local_name, p_brand AS sector,
    'parts' AS sector_en, 'list' AS shape, 0 AS r, -p_partkey AS o FROM n
  UNION ALL
  SELECT CASE lang WHEN 'en' THEN upper(source) ELSE source END,
    CASE lang WHEN 'en' THEN upper(source) ELSE source END, lang, '', 'map', 1, doc_id FROM documents)
SELECT upper(name) AS name_key, name, local_name, sector, sector_en, shape FROM entries
QUALIFY row_number() OVER (PARTITION BY upper(name) ORDER BY r, o) = 1
"""


def node_defaults(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_name").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    status = (
        table(spark, sf, "events", "user_id", "event_type")
        .groupBy(F.col("user_id").alias("id"))
        .agg(
            F.max(F.when(F.col("event_type") == "purchase", "Humans").otherwise("")).alias("owner"),
            F.count_if(F.col("event_type") == "click").alias("health"),
            F.count(F.lit(1)).alias("max_health"),
        )
    )
    return network.node_defaults(
        parts.join(status, "id", "left"),
        {"owner": fixed.OWNER_NONE, "health": 0, "max_health": 1},
    )


NODE_DEFAULTS = """
SELECT p_partkey AS id, p_name AS name, coalesce(nullif(owner, ''), 'None') AS owner,
  coalesce(health, 0) AS health, coalesce(nullif(max_health, 0), 1) AS max_health
FROM part LEFT JOIN (
  SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 'Humans' ELSE '' END) AS owner,
    count(*) FILTER (event_type = 'click') AS health, count(*) AS max_health
  FROM events GROUP BY 1) ON user_id = p_partkey
"""


def _in_region():
    return network.is_region(F.col("p_brand"), F.col("p_type"), "brand#7", "PROMO")


_LAYER = "CASE WHEN upper(p_brand) = 'BRAND#7' OR trim(p_type) = 'PROMO' THEN 'void' ELSE 'main' END"


def _nodes(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_brand", "p_type")
    return network.with_layer(parts, _in_region()).select(F.col("p_partkey").alias("id"), "layer")


def layer_split(spark, sf):
    return _nodes(spark, sf)


LAYER_SPLIT = f"SELECT p_partkey AS id, {_LAYER} AS layer FROM part"


def self_links(spark, sf):
    nodes = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderpriority").alias("faction")
    )
    return network.self_links(nodes, F.col("o_orderstatus") == "P", "faction")


SELF_LINKS = """
SELECT o_orderkey AS src, o_orderkey AS dst, o_orderpriority AS faction, CAST(1 AS DOUBLE) AS rate
FROM orders WHERE o_orderstatus = 'P'
"""


def _edges(spark, sf):
    return table(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")
    )


_PAIRS = """SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b
FROM lineitem"""


def edges_undirected(spark, sf):
    return network.undirected(_edges(spark, sf))


def edge_stats(spark, sf):
    return network.edge_stats(_edges(spark, sf))


EDGE_STATS = f"""
WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem)
SELECT (SELECT count(DISTINCT s) FROM d) AS sources, (SELECT count(*) FROM d) AS directed,
  (SELECT count(*) FROM ({_PAIRS})) AS undirected,
  (SELECT count(*) FROM d x JOIN d y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t) AS bidirectional
"""


def edges_in_layer(spark, sf):
    return network.edges_in_layer(_edges(spark, sf), _nodes(spark, sf))


EDGES_IN_LAYER = f"""
WITH n AS (SELECT p_partkey AS id, {_LAYER} AS layer FROM part)
SELECT x.layer, a, b FROM ({_PAIRS}) JOIN n x ON a = x.id JOIN n y ON b = y.id
WHERE x.layer = y.layer
"""


def incident_edges(spark, sf):
    nodes = table(spark, sf, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "id")
    return network.incident_edges(_edges(spark, sf).distinct(), nodes)


INCIDENT_EDGES = """
WITH d AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT s_suppkey AS node, src, dst FROM supplier JOIN d ON s_suppkey = src
UNION ALL
SELECT s_suppkey, src, dst FROM supplier JOIN d ON s_suppkey = dst WHERE src <> dst
"""


def _points(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        "label",
    )


def _projected(spark, sf):
    px, py = spatial.project(F.col("x"), F.col("y"), WIDTH, HEIGHT)
    return _points(spark, sf).withColumn("px", px).withColumn("py", py)


_POINTS = """SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  60 + (CAST(embedding[1] AS DOUBLE) + 1) / 2 * 1080 AS px,
  60 + (-CAST(embedding[2] AS DOUBLE) + 1) / 2 * 580 AS py FROM embeddings"""


def edge_cull(spark, sf):
    located = network.with_positions(
        network.undirected(_edges(spark, sf)).select(F.col("a").alias("src"), F.col("b").alias("dst")),
        _projected(spark, sf),
    )
    return network.cull_long(located, fixed.SCALE_MAX).select("src", "dst")


EDGE_CULL = f"""
WITH n AS ({_POINTS})
SELECT a AS src, b AS dst FROM ({_PAIRS}) JOIN n s ON a = s.id JOIN n t ON b = t.id
WHERE abs(t.px - s.px) <= 200 AND abs(t.py - s.py) <= 200
"""


def project_points(spark, sf):
    sx, sy = spatial.to_screen(F.col("px"), F.col("py"), 1.5, -30.0, 20.0)
    wx, wy = spatial.to_world(F.col("px"), F.col("py"), 1.5, -30.0, 20.0)
    _, flat = spatial.project(F.col("x"), F.col("y"), WIDTH, HEIGHT, flip=False)
    columns = {"px": F.col("px"), "py": F.col("py"), "py_unflipped": flat, "screen_x": sx,
               "screen_y": sy, "world_x": wx, "world_y": wy}
    return _projected(spark, sf).select(
        "id", *[F.round(column, 4).alias(name) for name, column in columns.items()]
    )


PROJECT_POINTS = f"""
SELECT id, round(px, 4) AS px, round(py, 4) AS py, round(60 + (y + 1) / 2 * 580, 4) AS py_unflipped,
  round(px * 1.5::DOUBLE + -30, 4) AS screen_x, round(py * 1.5::DOUBLE + 20, 4) AS screen_y,
  round((px - -30) / 1.5::DOUBLE, 4) AS world_x, round((py - 20) / 1.5::DOUBLE, 4) AS world_y
FROM ({_POINTS})
"""


def group_bounds(spark, sf):
    sector = F.nullif(F.col("label"), F.lit(0)).cast("string")
    boxes = spatial.group_bounds(_projected(spark, sf), sector)
    return boxes.select(
        "sector", "nodes", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")]
    )


GROUP_BOUNDS = f"""
SELECT coalesce(CAST(nullif(label, 0) AS VARCHAR), '{fixed.SECTOR_MISSING}') AS sector,
  count(*) AS nodes, round(min(px) - 20, 4) AS x, round(min(py) - 20, 4) AS y,
  round(max(px) - min(px) + 40, 4) AS width, round(max(py) - min(py) + 40, 4) AS height
FROM ({_POINTS}) GROUP BY 1
"""


def fit_to_view(spark, sf):
    fitted = spatial.fit_to_view(spatial.bounds(_projected(spark, sf)), WIDTH, HEIGHT)
    return fitted.select(*[F.round(c, 4).alias(c) for c in fitted.columns])


FIT_TO_VIEW = f"""
WITH b AS (SELECT min(px) AS min_x, max(px) AS max_x, min(py) AS min_y, max(py) AS max_y FROM ({_POINTS})),
s AS (SELECT *, least(3, greatest(0.3::DOUBLE, least(1080 / (max_x - min_x), 580 / (max_y - min_y),
  1.5::DOUBLE))) AS scale FROM b)
SELECT round(min_x, 4) AS min_x, round(max_x, 4) AS max_x, round(min_y, 4) AS min_y,
  round(max_y, 4) AS max_y, round(scale, 4) AS scale,
  round((1200 - (min_x + max_x) * scale) / 2, 4) AS offset_x,
  round((700 - (min_y + max_y) * scale) / 2, 4) AS offset_y
FROM s
"""


def radius_hit(spark, sf):
    points = _points(spark, sf)
    hits = spatial.radius_hit(
        points.select(F.col("id").alias("probe_id"), "x", "y"),
        points.select("x", "y", F.col("id").alias("draw_order")),
        HIT,
    )
    return hits.select("probe_id", F.col("draw_order").alias("node_id"))


RADIUS_HIT = f"""
WITH n AS ({_POINTS})
SELECT p.id AS probe_id, max(n.id) AS node_id FROM n p JOIN n
  ON (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) < {HIT} * {HIT}::DOUBLE
GROUP BY p.id
"""

QUERIES = {
    "name_index": (name_index, NAME_INDEX),
    "node_defaults": (node_defaults, NODE_DEFAULTS),
    "layer_split": (layer_split, LAYER_SPLIT),
    "self_links": (self_links, SELF_LINKS),
    "edges_undirected": (edges_undirected, _PAIRS),
    "edge_stats": (edge_stats, EDGE_STATS),
    "edges_in_layer": (edges_in_layer, EDGES_IN_LAYER),
    "incident_edges": (incident_edges, INCIDENT_EDGES),
    "edge_cull": (edge_cull, EDGE_CULL),
    "project_points": (project_points, PROJECT_POINTS),
    "group_bounds": (group_bounds, GROUP_BOUNDS),
    "fit_to_view": (fit_to_view, FIT_TO_VIEW),
    "radius_hit": (radius_hit, RADIUS_HIT),
}
