"""Name resolution, layers and edges between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.functions import falsy, fixed
from pollweave.operators.history import first_per_key


def name_index(nested: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per upper-case name from a nested list and a keyed map.

    Both sides have ``name, local_name, sector, sector_en, seq``. The nested list
    wins over the map; inside the list the last entry wins, inside the map the
    first. Entries without a name are left out.
    """
    sides = nested.withColumn("_shape", F.lit(0)).withColumn("_order", -F.col("seq")).unionByName(
        keyed.withColumn("_shape", F.lit(1)).withColumn("_order", F.col("seq"))
    )
    named = sides.where(falsy.text(F.col("name")).isNotNull()).select(
        F.upper("name").alias("name_key"),
        "name",
        falsy.first_text(F.col("local_name"), F.col("name")).alias("local_name"),
        falsy.first_text(F.col("sector"), F.col("sector_en"), F.lit("")).alias("sector"),
        F.coalesce("sector_en", F.lit("")).alias("sector_en"),
        F.when(F.col("_shape") == 0, "list").otherwise("map").alias("shape"),
        "_shape",
        "_order",
    )
    picked = first_per_key(named, ["name_key"], [F.col("_shape"), F.col("_order")])
    return picked.drop("_shape", "_order")


def first_by_name(df: DataFrame, name: str, order: Column) -> DataFrame:
    """One row per case-insensitive name, the first in ``order``, keyed by ``name_key``."""
    keyed = df.withColumn("name_key", F.upper(name)).withColumn("_order", order)
    return first_per_key(keyed, ["name_key"], [F.col("_order")]).drop("_order")


def join_by_name(rows: DataFrame, name: str, by_name: DataFrame) -> DataFrame:
    """Left join a ``name_key`` table on the upper-cased name; never fans out."""
    return (
        rows.withColumn("name_key", F.upper(F.coalesce(F.col(name), F.lit(""))))
        .join(by_name, "name_key", "left")
        .drop("name_key")
    )


def resolve_names(rows: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """Display name and sector from the name index as ``shown_name, shown_sector, shown_sector_en``.

    A name the index lacks is shown as it is, a missing one as unknown.
    """
    shown = index.select(
        "name_key",
        F.col("local_name").alias("shown_name"),
        F.col("sector").alias("shown_sector"),
        F.col("sector_en").alias("shown_sector_en"),
    )
    return join_by_name(rows, name, shown).withColumns(
        {
            "shown_name": falsy.first_text(
                F.col("shown_name"), F.col(name), F.lit(fixed.NAME_MISSING)
            ),
            "shown_sector": F.coalesce("shown_sector", F.lit("")),
            "shown_sector_en": F.coalesce("shown_sector_en", F.lit("")),
        }
    )


def with_exists(
    rows: DataFrame,
    found: DataFrame,
    keys: list[str],
    order: list[Column],
    defaults: dict[str, object],
    flag: str = "exists",
) -> DataFrame:
    """Add a flag for rows that have a match and the first match's attributes.

    Attributes of a match fall back to their default when empty; rows without a
    match get null.
    """
    first = first_per_key(found.where(F.col(keys[0]).isNotNull()), keys, order)
    matched = first.select(
        *keys,
        F.lit(True).alias(flag),
        *[F.coalesce(falsy.text(F.col(c)), F.lit(d)).alias(c) for c, d in defaults.items()],
    )
    return rows.join(matched, keys, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def anti_fill(
    keyed: DataFrame, nested: DataFrame, key: Column | str, order: Column, origin: str = "origin"
) -> DataFrame:
    """The keyed rows plus the nested ones whose key the keyed side lacks.

    ``key`` is computed on both sides, e.g. ``upper(name)``; of nested rows with the same
    key the first in ``order`` counts.
    """
    key = F.col(key) if isinstance(key, str) else key
    known = keyed.select(key.alias("_key")).distinct()
    missing = nested.withColumn("_key", key).join(known, "_key", "left_anti")
    extra = first_per_key(missing, ["_key"], [order]).drop("_key")
    return keyed.withColumn(origin, F.lit("keyed")).unionByName(
        extra.withColumn(origin, F.lit("filled")), True
    )


def is_region(
    name: Column,
    local_name: Column,
    region: str = fixed.VOID_REGION,
    local_region: str = fixed.VOID_REGION_LOCAL,
) -> Column:
    """Whether a sector is the region, by English name in any case or by local name."""
    by_name = F.upper(F.coalesce(name, F.lit(""))) == region.upper()
    return by_name | (F.trim(F.coalesce(local_name, F.lit(""))) == local_region)


def with_layer(df: DataFrame, in_region: Column, inside="void", outside="main") -> DataFrame:
    """Route rows into two layers; write with ``partitionBy('layer')``."""
    return df.withColumn("layer", F.when(in_region, inside).otherwise(outside))


def undirected(edges: DataFrame, *extra: str) -> DataFrame:
    """One row per unordered pair ``(a, b)`` with a <= b."""
    pair = edges.select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *extra
    )
    return pair.distinct()


def pair_directions(edges: DataFrame) -> DataFrame:
    """Per unordered pair whether it occurs forwards, backwards or both."""
    forward = F.col("src") <= F.col("dst")
    return edges.groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(
        F.max(F.when(forward, 1).otherwise(0)).alias("forward"),
        F.max(F.when(forward, 0).otherwise(1)).alias("backward"),
    )


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row: sources, directed, undirected and bidirectional edges."""
    pairs = pair_directions(edges).agg(
        F.sum(F.col("forward") + F.col("backward")).cast("bigint").alias("directed"),
        F.count(F.lit(1)).alias("undirected"),
        F.sum(F.col("forward") * F.col("backward")).cast("bigint").alias("bidirectional"),
    )
    sources = edges.select("src").distinct().agg(F.count(F.lit(1)).alias("sources"))
    return pairs.select(
        sources.scalar().alias("sources"), "directed", "undirected", "bidirectional"
    )


def edges_in_layer(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected edges with both ends in the same layer; ``nodes`` has ``id, layer``.

    Edges are reduced to distinct pairs before they meet the nodes.
    """
    ends = nodes.select("id", "layer")
    return (
        undirected(edges)
        .join(ends.select(F.col("id").alias("a"), "layer"), "a")
        .join(ends.select(F.col("id").alias("b"), F.col("layer").alias("_layer_b")), "b")
        .where(F.col("layer") == F.col("_layer_b"))
        .select("layer", "a", "b")
    )


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges at each node as ``(node, src, dst)``; a self-link counts once."""
    ids = nodes.select(F.col("id").alias("node"))
    out = edges.join(ids, F.col("src") == F.col("node"))
    into = edges.where(F.col("src") != F.col("dst")).join(ids, F.col("dst") == F.col("node"))
    return out.select("node", "src", "dst").unionByName(into.select("node", "src", "dst"))


def self_links(nodes: DataFrame, active: Column, *attributes: str) -> DataFrame:
    """A link from each active node to itself at rate 1."""
    return nodes.where(active).select(
        F.col("id").alias("src"), F.col("id").alias("dst"), *attributes, F.lit(1.0).alias("rate")
    )


def cull_long(edges: DataFrame, scale: float = 1.0, span: float = fixed.EDGE_SPAN) -> DataFrame:
    """Edges no longer than span / scale on either axis; missing positions are dropped.

    ``edges`` carries ``sx, sy, tx, ty``.
    """
    near = [
        F.abs(F.col(t) - F.col(s)) <= span / scale for s, t in (("sx", "tx"), ("sy", "ty"))
    ]
    return edges.where(near[0] & near[1])


def with_positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the positions of both ends; ``nodes`` has ``id, px, py``."""
    source = nodes.select(F.col("id").alias("src"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    target = nodes.select(F.col("id").alias("dst"), F.col("px").alias("tx"), F.col("py").alias("ty"))
    return edges.join(source, "src").join(target, "dst")


def node_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill what no status was found for: numbers also when 0, text also when empty."""
    filled = {}
    for column, default in defaults.items():
        drop = falsy.text if isinstance(default, str) else falsy.number
        filled[column] = F.coalesce(drop(F.col(column)), F.lit(default))
    return rows.withColumns(filled)
