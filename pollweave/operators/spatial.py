"""Projection, bounds, view fitting and point-in-radius matching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.functions import falsy, fixed
from pollweave.session import checkpointed


def project(
    x: Column,
    y: Column,
    width: float,
    height: float,
    margin: float = fixed.VIEW_MARGIN,
    flip: bool = True,
) -> tuple[Column, Column]:
    """Coordinates in [-1, 1] as pixels inside the margin; y points up unless ``flip`` is off."""
    up = -y if flip else y
    px = F.lit(margin) + (x + 1) / 2 * (width - 2 * margin)
    py = F.lit(margin) + (up + 1) / 2 * (height - 2 * margin)
    return px, py


def to_screen(x: Column, y: Column, scale, offset_x, offset_y) -> tuple[Column, Column]:
    """World to screen."""
    return x * scale + offset_x, y * scale + offset_y


def to_world(x: Column, y: Column, scale, offset_x, offset_y) -> tuple[Column, Column]:
    """Screen to world."""
    return (x - offset_x) / scale, (y - offset_y) / scale


def bounds(df: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """One row with the bounding box of all points; nulls are skipped."""
    return df.agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"),
        F.min(y).alias("min_y"), F.max(y).alias("max_y"),
    )


def group_bounds(
    df: DataFrame,
    group: Column,
    x: str = "px",
    y: str = "py",
    pad: float = fixed.GROUP_PAD,
    missing: str = fixed.SECTOR_MISSING,
) -> DataFrame:
    """Padded bounding box per group; rows without a group share one."""
    name = F.coalesce(falsy.text(group), F.lit(missing)).alias("sector")
    return df.groupBy(name).agg(
        (F.min(x) - pad).alias("x"),
        (F.min(y) - pad).alias("y"),
        (F.max(x) - F.min(x) + 2 * pad).alias("width"),
        (F.max(y) - F.min(y) + 2 * pad).alias("height"),
        F.count(F.lit(1)).alias("nodes"),
    )


def fit_to_view(
    box: DataFrame, width: float, height: float, margin: float = fixed.VIEW_MARGIN
) -> DataFrame:
    """Scale and offsets that show the whole bounding box centred.

    The points have to be projected before their bounds are taken. No row for no
    points.
    """
    content_w = falsy.first_number(F.col("max_x") - F.col("min_x"), F.lit(1.0))
    content_h = falsy.first_number(F.col("max_y") - F.col("min_y"), F.lit(1.0))
    fitted = F.least(
        (width - 2 * margin) / content_w, (height - 2 * margin) / content_h, F.lit(fixed.SCALE_FIT)
    )
    scale = F.least(F.lit(fixed.SCALE_MAX), F.greatest(F.lit(fixed.SCALE_MIN), fitted))
    return (
        box.where(F.col("min_x").isNotNull() & F.col("min_y").isNotNull())
        .withColumn("scale", scale)
        .withColumn("offset_x", (width - (F.col("min_x") + F.col("max_x")) * F.col("scale")) / 2)
        .withColumn("offset_y", (height - (F.col("min_y") + F.col("max_y")) * F.col("scale")) / 2)
    )


# Points per finest cell that are compared one by one.
LEAF_POINTS = 64
# Below this size, a billionth of the radius, cells no longer tell points apart.
_MAX_LEVELS = 30
# Relative slack of the cell tests, far above rounding; points are tested exactly.
_SLACK = 1e-6


def radius_hit(
    probes: DataFrame, nodes: DataFrame, radius: float, levels: int | None = None
) -> DataFrame:
    """Per probe the last-drawn node closer than ``radius``: ``(probe_id, draw_order)``.

    ``probes`` has a unique ``probe_id`` and ``x, y``; ``nodes`` has ``x, y`` and a
    unique ``draw_order``. Probes that hit nothing are left out.

    Points meet through grid cells, never as all pairs. Only the last-drawn node
    of a position counts, and a cell that lies wholly inside the radius counts as
    its last-drawn node alone. Cells cut by the circle are split into four, level
    by level, until the fullest cell holds few points; only the points of those
    thin edge cells that were drawn after the best node found so far are compared
    one by one.
    """
    placed = nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    points = placed.groupBy("x", "y").agg(F.max("draw_order").alias("draw_order"))
    seekers = probes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        "probe_id",
        F.col("x").alias("qx"),
        F.col("y").alias("qy"),
        F.lit(None).cast(nodes.schema["draw_order"].dataType).alias("best"),
    )
    levels = max(1, _levels(points, radius) if levels is None else levels)
    limit = radius * radius

    # The first level has cells of half the radius: 5 x 5 of them cover the circle.
    cells = _spread(seekers, _cell("qx", radius / 2), _cell("qy", radius / 2), range(-2, 3))
    found = None
    for depth in range(1, levels + 1):
        size = radius / 2**depth
        tops = points.groupBy(_cell("x", size).alias("cx"), _cell("y", size).alias("cy")).agg(
            F.max("draw_order").alias("top")
        )
        inside = F.col("far2") < limit * (1 - _SLACK)
        cut = ~inside & (F.col("near2") < limit * (1 + _SLACK))
        # One row per probe; its list holds the cells along the circle, a number that
        # the geometry bounds.
        probed = (
            cells.join(tops, ["cx", "cy"])
            .withColumns(_distances(size))
            .where(inside | cut)
            .groupBy("probe_id")
            .agg(
                F.max("qx").alias("qx"),
                F.max("qy").alias("qy"),
                F.greatest(F.max("best"), F.max(F.when(inside, F.col("top")))).alias("best"),
                F.collect_list(F.when(cut, F.struct("cx", "cy", "top"))).alias("cut"),
            )
        )
        settled = probed.where(F.col("best").isNotNull()).select("probe_id", "best")
        found = settled if found is None else found.unionByName(settled)
        edge = (
            probed.select("probe_id", "qx", "qy", "best", F.explode("cut").alias("cell"))
            .where(F.col("best").isNull() | (F.col("cell.top") > F.col("best")))
            .select("probe_id", "qx", "qy", "best", "cell.cx", "cell.cy")
        )
        if depth < levels:
            cells = _spread(edge, F.col("cx") * 2, F.col("cy") * 2, (0, 1))
            if depth % 4 == 0:  # many levels only where points crowd: keep the plan short
                cells = checkpointed(cells)

    leaf_points = points.select(
        _cell("x", size).alias("cx"), _cell("y", size).alias("cy"), "x", "y", "draw_order"
    )
    gap_x, gap_y = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    edge_hits = (
        edge.join(leaf_points, ["cx", "cy"])
        .where(F.col("best").isNull() | (F.col("draw_order") > F.col("best")))
        .where(gap_x * gap_x + gap_y * gap_y < limit)
        .select("probe_id", F.col("draw_order").alias("best"))
    )
    return (
        found.unionByName(edge_hits).groupBy("probe_id").agg(F.max("best").alias("draw_order"))
    )


def _spread(rows: DataFrame, cx: Column, cy: Column, steps) -> DataFrame:
    """Each probe with the cells at the given steps from (cx, cy) on both axes."""
    offsets = F.array(*[F.lit(d).cast("bigint") for d in steps])
    kept = ["probe_id", "qx", "qy", "best"]
    return (
        rows.select(*kept, cx.alias("bx"), cy.alias("by"))
        .withColumn("sx", F.explode(offsets))
        .withColumn("sy", F.explode(offsets))
        .select(
            *kept,
            (F.col("bx") + F.col("sx")).alias("cx"),
            (F.col("by") + F.col("sy")).alias("cy"),
        )
    )


def _cell(column: str, size: float) -> Column:
    return F.floor(F.col(column) / F.lit(float(size)))


def _distances(size: float) -> dict[str, Column]:
    """Squared distance from the probe to the nearest and farthest corner of a cell."""
    nearest, farthest = [], []
    for probe, cell in (("qx", "cx"), ("qy", "cy")):
        low = F.col(cell) * F.lit(float(size)) - F.col(probe)
        high = low + F.lit(float(size))
        nearest.append(F.greatest(low, -high, F.lit(0.0)))
        farthest.append(F.greatest(F.abs(low), F.abs(high)))
    return {
        "near2": nearest[0] * nearest[0] + nearest[1] * nearest[1],
        "far2": farthest[0] * farthest[0] + farthest[1] * farthest[1],
    }


def _levels(points: DataFrame, radius: float) -> int:
    """How often to split until the fullest cell holds few points; a split quarters it."""
    levels = 1
    while levels < _MAX_LEVELS:
        size = radius / 2**levels
        cells = points.groupBy(_cell("x", size).alias("cx"), _cell("y", size).alias("cy")).count()
        fullest = cells.agg(F.max("count").alias("n")).first()["n"] or 0
        if fullest <= LEAF_POINTS:
            break
        levels += max(1, math.ceil(math.log(fullest / LEAF_POINTS, 4)))
    return min(levels, _MAX_LEVELS)
