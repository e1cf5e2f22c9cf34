"""Which source wins: for a whole poll, for a record, or for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.functions import falsy, normalize

SOURCE = "source"


def stack(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources under one another, in order of precedence, with label and rank.

    Columns a source lacks are null.
    """
    stacked = None
    for rank, (label, df) in enumerate(sources.items()):
        rows = df.withColumn(SOURCE, F.lit(label)).withColumn("source_rank", F.lit(rank))
        stacked = rows if stacked is None else stacked.unionByName(rows, True)
    if stacked is None:
        raise ValueError("no source given")
    return stacked


def whole_poll(stacked: DataFrame, polls: list[str]) -> DataFrame:
    """Per poll all rows of the first source that has any.

    The ranks are one row per poll; a poll or source with most of the rows is
    only ever the probe side of the join.
    """
    best = stacked.groupBy(*polls).agg(F.min("source_rank").alias("source_rank"))
    return stacked.join(best, [*polls, "source_rank"], "left_semi")


def whole_record(stacked: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the whole record of the first source that knows the key.

    Of several records of that source the least counts.
    """
    others = [c for c in stacked.columns if c not in (*keys, "source_rank")]
    return (
        stacked.groupBy(*keys)
        .agg(F.min_by(F.struct(*others), F.struct("source_rank", *others)).alias("_row"))
        .select(*keys, "_row.*")
    )


def by_field(
    stacked: DataFrame, keys: list[str], policy: dict[str, list[str]], present: dict[str, Column]
) -> DataFrame:
    """Per key each field from the first source of the field's own order that has it.

    ``policy`` maps a field to source labels, best first. ``present`` gives, per
    field, the value with "absent" already turned into null. Adds
    ``<field>_source``. One aggregate settles all the fields.
    """
    picks = []
    for field, labels in policy.items():
        rank = normalize.lookup(F.col(SOURCE), {label: i for i, label in enumerate(labels)})
        value = present[field]
        candidate = F.struct(
            rank.alias("rank"), value.alias("value"), F.col(SOURCE).alias("source")
        )
        usable = rank.isNotNull() & value.isNotNull()
        picks.append(F.min_by(candidate, F.when(usable, F.struct(rank, value))).alias(f"_{field}"))
    fields = []
    for field in policy:
        fields += [
            F.col(f"_{field}.value").alias(field),
            F.col(f"_{field}.source").alias(f"{field}_source"),
        ]
    return stacked.groupBy(*keys).agg(*picks).select(*keys, *fields)


def override(*values: Column, default: str) -> Column:
    """First non-empty text of an override chain, else the literal."""
    return F.coalesce(*[falsy.text(v) for v in values], F.lit(default))
