"""The map job: nodes, layers, edges and links of one poll."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pollweave.functions import falsy, fixed
from pollweave.operators import network, spatial
from pollweave.operators.history import first_per_key

_DEFAULTS = {
    "owner": fixed.OWNER_NONE, "health": 0, "max_health": 1, "players": 0, "resistance": 0.0
}


@dataclass
class Atlas:
    nodes: DataFrame
    supply_lines: DataFrame
    links: DataFrame


def nested_members(atlas: DataFrame) -> DataFrame:
    """The list shape: one row per system member, in document order."""
    systems = atlas.select(F.posexplode("doc.systems").alias("s", "system"))
    members = systems.select("s", "system", F.posexplode("system.planets").alias("p", "member"))
    return members.select(
        F.col("member.id").alias("id"),
        F.col("member.en").alias("name"),
        F.col("member.cn").alias("local_name"),
        falsy.first_text(F.col("system.name"), F.col("system.name_en")).alias("sector"),
        F.col("system.name_en").alias("sector_en"),
        F.col("member.position.x").alias("x"),
        F.col("member.position.y").alias("y"),
        # Both are positions below 2**31, so the order is exact whatever their number.
        (F.shiftleft(F.col("s").cast("bigint"), 31) + F.col("p")).alias("seq"),
    )


def keyed_members(atlas: DataFrame) -> DataFrame:
    """The map shape: one row per entry."""
    entries = atlas.select(F.posexplode("doc.planets").alias("s", "name", "entry"))
    return entries.select(
        F.col("entry.ID").alias("id"),
        "name",
        F.col("entry.cn").alias("local_name"),
        falsy.first_text(F.col("entry.system"), F.col("entry.sector")).alias("sector"),
        F.col("entry.sector_en").alias("sector_en"),
        F.col("entry.position.x").alias("x"),
        F.col("entry.position.y").alias("y"),
        F.col("s").cast("bigint").alias("seq"),
    )


def build(
    atlas: DataFrame, waypoints: DataFrame, entities: DataFrame, contests: DataFrame
) -> Atlas:
    """Nodes with status and layer, supply lines inside each layer, links of contested nodes.

    ``entities`` and ``contests`` are one poll's tables. Unknown positions stay null.
    """
    nested, keyed = nested_members(atlas), keyed_members(atlas)
    index = network.name_index(nested.drop("id", "x", "y"), keyed.drop("id", "x", "y"))
    named = nested.where(falsy.text(F.col("name")).isNotNull())
    members = network.anti_fill(
        keyed, named.drop("id", "x", "y"), F.upper("name"), F.col("seq")
    ).drop("seq")
    located = network.resolve_names(members, "name", index)
    status = network.first_by_name(
        entities.select(
            "name", "entity_id", "owner", "health", "max_health", "players", "resistance"
        ).where(F.col("name").isNotNull()),
        "name",
        F.col("entity_id"),
    ).drop("name")
    found = network.join_by_name(located, "name", status)
    flagged = network.with_exists(
        found,
        contests.select("entity_id", "seq", "contest_class", "faction"),
        ["entity_id"],
        [F.col("seq")],
        {"contest_class": fixed.LIBERATION, "faction": ""},
        "is_contested",
    )
    nodes = network.node_defaults(flagged, _DEFAULTS).select(
        F.when(F.col("origin") == "keyed", F.col("id"))
        .otherwise(F.coalesce("entity_id", F.lit(-1)))
        .alias("id"),
        F.col("shown_name").alias("name"),
        F.col("name").alias("name_en"),
        F.coalesce(falsy.text(F.col("shown_sector")), F.col("sector"), F.lit("")).alias("sector"),
        F.coalesce(falsy.text(F.col("shown_sector_en")), F.col("sector_en"), F.lit("")).alias(
            "sector_en"
        ),
        "x",
        "y",
        *_DEFAULTS,
        "is_contested",
        F.col("contest_class").alias("contest_type"),
        F.coalesce("faction", F.lit("")).alias("faction"),
    )
    nodes = network.with_layer(nodes, network.is_region(F.col("sector_en"), F.col("sector")))
    return Atlas(
        nodes=nodes,
        supply_lines=network.edges_in_layer(edges(waypoints), nodes),
        links=network.self_links(nodes, F.col("is_contested"), "layer", "faction", "contest_type"),
    )


def member_info(atlas: DataFrame) -> DataFrame:
    """One row per exact name with id, local name, sector and position.

    Here the map wins over the list, and the first list entry of a name counts.
    """
    shapes = keyed_members(atlas).withColumn("_shape", F.lit(0)).unionByName(
        nested_members(atlas).withColumn("_shape", F.lit(1))
    )
    named = shapes.where(falsy.text(F.col("name")).isNotNull())
    first = first_per_key(named, ["name"], [F.col("_shape"), F.col("seq")])
    return first.drop("_shape", "seq").withColumns(
        {
            "local_name": falsy.first_text(F.col("local_name"), F.col("name")),
            "sector": F.coalesce("sector", F.lit("")),
            "sector_en": F.coalesce("sector_en", F.lit("")),
        }
    )


def edges(waypoints: DataFrame) -> DataFrame:
    """Directed edges of the adjacency map."""
    lists = waypoints.select(F.explode("doc.waypoints").alias("src", "targets"))
    return lists.select(F.col("src").cast("bigint").alias("src"), F.explode("targets").alias("dst"))


def projected(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """Nodes with pixel positions ``px, py``."""
    px, py = spatial.project(F.col("x"), F.col("y"), width, height)
    return nodes.withColumns({"px": px, "py": py})


def layer_counts(atlas: Atlas) -> DataFrame:
    """Nodes, links and nodes without a position per layer."""
    nodes = atlas.nodes.groupBy("layer").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("x").isNull()).alias("unplaced")
    )
    links = atlas.links.groupBy("layer").agg(F.count(F.lit(1)).alias("links"))
    return nodes.join(links, "layer", "left").withColumn(
        "links", F.coalesce("links", F.lit(0))
    )
