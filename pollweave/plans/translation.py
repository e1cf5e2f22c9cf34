"""The translation job: attach translated text to each poll's document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pollweave.operators import history
from pollweave.sources import documents as docs
from pollweave.sources.documents import POLL

# What one poll leaves to the next.
OWNED = f"""{POLL} bigint, major_order struct<title: string, brief: string,
  translated_brief: string, translated_at: string>, news array<{docs.NEWS_ITEM}>"""


def owned_columns(
    polls: DataFrame, translations: DataFrame, earlier: DataFrame | None = None
) -> DataFrame:
    """Per poll ``news`` and ``major_order``, those of the poll before where none arrived.

    ``translations`` is ``(poll_ts, doc)``; a defective document is not among them.
    ``earlier`` holds these columns of polls settled before. Of the items only objects
    are kept. Empty values stand where no poll so far had a translation.
    """
    brief = F.col("doc.mo_brief")
    texts = {
        "title": brief["title"],
        "brief": brief["original"],
        "translated_brief": brief["translated"],
        "translated_at": brief["translated_at"],
    }
    objects = F.filter("doc.items", lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    news = F.transform(objects, lambda v: F.try_variant_get(v, "$", docs.NEWS_ITEM))
    order = F.struct(*[F.coalesce(v, F.lit("")).alias(k) for k, v in texts.items()])
    empty = F.array().cast(f"array<{docs.NEWS_ITEM}>")
    arrived = F.struct(order.alias("major_order"), F.coalesce(news, empty).alias("news"))
    rows = polls.select(POLL).join(translations.select(POLL, "doc"), POLL, "left").select(
        POLL, F.when(F.col("doc").isNotNull(), arrived).alias("owned"), F.lit(True).alias("_new"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(
            POLL, F.struct("major_order", "news").alias("owned"), F.lit(False).alias("_new")))
    filled = history.carry_forward(
        rows.withColumn("_series", F.lit(0)), ["_series"], [POLL], ["owned"])
    nothing = F.struct(*[F.lit("").alias(k) for k in texts])
    return filled.where("_new").select(
        POLL,
        F.coalesce("owned.major_order", nothing).alias("major_order"),
        F.coalesce("owned.news", empty).alias("news"),
    )
