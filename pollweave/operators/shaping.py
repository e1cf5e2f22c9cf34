"""Nested records to rows and back, unions and columns with another owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.operators.history import first_per_key


def explode_items(df: DataFrame, items: Column, *keep: str, outer: bool = False) -> DataFrame:
    """One row per list element, struct fields as columns, with the position ``pos``."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select(*keep, explode(items).alias("pos", "item"))
    return rows.select(*keep, "pos", "item.*") if _is_struct(rows) else rows


def _is_struct(rows: DataFrame) -> bool:
    return rows.schema["item"].dataType.typeName() == "struct"


def explode_map(df: DataFrame, entries: Column, *keep: str) -> DataFrame:
    """One row per map entry as ``entry_key, entry_value``."""
    return df.select(*keep, F.explode(entries).alias("entry_key", "entry_value"))


def first_item(items: Column) -> Column:
    """First element, null for an empty or missing list."""
    return F.get(items, 0)


def present_items(items: Column) -> Column:
    """The list without null elements; an empty list when missing."""
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array())


def distinct_in_order(df: DataFrame, keys: list[str], value: str, position: Column) -> DataFrame:
    """Per key the distinct values as an array, in first-seen order.

    Repeats are reduced to one row per (key, value) before the arrays are built.
    """
    firsts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.min(position).alias("_first"))
    )
    pairs = F.array_sort(F.collect_list(F.struct("_first", value)))
    return firsts.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(f"{value}s"))


def keyed_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both tables under one another; columns only one of them has are null in the other."""
    return left.unionByName(right, allowMissingColumns=True)


def keep_owned(
    fresh: DataFrame, previous: DataFrame, keys: list[str], owned: dict[str, object]
) -> DataFrame:
    """Fresh rows with the columns another writer owns taken from the previous output.

    ``owned`` maps each such column to its default where nothing was written yet.
    """
    kept = first_per_key(
        previous.select(*keys, *owned), keys, [F.to_json(F.struct(*owned))]
    )
    joined = fresh.drop(*owned).join(kept, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in owned.items()})


def counts_record(
    df: DataFrame, keys: list[str], kind: str, labels: dict[str, str], total: str = "total"
) -> DataFrame:
    """Wide counts per kind: one row per key, a column per label and the total."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        *[F.count_if(F.col(kind) == value).alias(name) for value, name in labels.items()],
    )


def nest(df: DataFrame, keys: list[str], name: str, fields: list[str], **kept: str) -> DataFrame:
    """Move wide columns into one struct; ``kept`` copies a metric up to the result."""
    return df.select(
        *keys,
        F.struct(*fields).alias(name),
        *[F.col(column).alias(alias) for alias, column in kept.items()],
    )


def nested_lists(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Per key the rows as a sorted array of structs.

    For lists bounded by a catalogue (the entities of one poll); reduce first.
    """
    fields = [c for c in rows.columns if c not in keys]
    ranked = [*order, *[c for c in fields if c not in order]]
    items = F.array_sort(F.collect_list(F.struct(*ranked)))
    return rows.groupBy(*keys).agg(items.alias(name))


def as_document(df: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """Each row as one JSON document next to its key; null fields are written."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*keys, body.alias(name))
