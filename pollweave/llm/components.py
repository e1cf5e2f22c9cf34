"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pollweave.llm.common import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _starred(neighbours: DataFrame, edges: DataFrame, least) -> DataFrame:
    """Every neighbour of a node points to the least of them and the node."""
    centres = neighbours.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low"))
    return least(edges.join(centres, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v): the least node it can reach.

    Large-star and small-star rounds: each joins every edge with the least neighbour of
    its node, an aggregate. Rounds are written to the shared folder; only a row count and
    a checksum come to the driver. Loops and null ends are left out; no edges, no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if state == before:
            break
        before = state
        both = _both_ways(edges)
        large = _starred(
            both, both, lambda e: e.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct()
        small = _starred(
            large, large,
            lambda e: e.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
                e.select("u", F.col("low").alias("v"))),
        ).where("u <> v").distinct()
        edges = staged(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
