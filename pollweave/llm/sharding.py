"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.llm.common import staged
from pollweave.llm.ordering import numbered


def _score(key: Column, shard: int, weight: float) -> Column:
    """ln(u) / weight for a u in (0, 1) that key and shard decide; the largest wins."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11)
    u = (draw.cast("double") + 0.5) / float(1 << 53)
    return F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins ``key`` (as text); a tie goes to the lower shard.

    A shard of weight w gets w / sum(weights) of the keys. Only keys and weights decide:
    without a shard only its keys move, and a new shard takes keys only into itself. A
    weight of 0 gives a shard nothing. Null is a key like any other.
    """
    live = [(n, w) for n, w in enumerate(weights) if w > 0]
    if not live or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    text = F.coalesce(key.cast("string"), F.lit("\0"))
    return F.array_max(
        F.array(*[
            F.struct(_score(text, n, w).alias("score"), F.lit(-n).alias("shard"))
            for n, w in live
        ])
    )["shard"] * F.lit(-1)


def assign(
    df: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
    added: float | None = None,
) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, shard, slot and grown_shard.

    ``size`` is the UTF-8 length of the text plus 16; a null text has length 0 and the
    checksum of the empty text. ``slot`` numbers a shard's rows from 0 without gaps.
    ``grown_shard`` is the shard after one more shard of weight ``added`` (default: the
    last weight) has joined. Repeated keys share a shard and have slots of their own; an
    empty table gives no rows; other columns are not read.
    """
    added = added if added is not None else (weights[-1] if weights else 1.0)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    placed = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, added]).alias("grown_shard"),
    )
    return numbered(staged(placed, "shards"), ["shard"], ["key", "text_crc32", "size"], "slot")
