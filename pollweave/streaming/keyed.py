"""Rows next to one another along a key's order, as keyed state of a stream.

The processor keeps and looks up plain values, in the lists that a batch's own rows fall into;
whatever is computed from them is a column expression on its output, the same as in batch.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

# Workers need not have this package: the processors travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one list in the state; a list that grows beyond is cut in two. A list of plain numbers
# takes some 4 kB: an answer of the state beyond 8 kB leaves in two packets, which takes 40 ms.
LIST_ROWS = 128
# Groups that the keys are dealt to by their hash. A group's short keys share lists, so a batch
# makes a few calls to the state per list and none per key.
BUCKETS = 1024
BUCKET = "_bucket"


class _End:
    """Before every value, or behind every one."""

    def __init__(self, first: bool) -> None:
        self.first = first

    def __lt__(self, other) -> bool:
        return self.first and other is not self

    def __gt__(self, other) -> bool:
        return not self.first and other is not self


NULL, NAN = _End(True), _End(False)


def _place(position) -> tuple:
    """A position that can be compared: null first, NaN last."""
    return tuple(NULL if x is None else NAN if x != x else x for x in position)


def _position(place) -> tuple:
    return tuple(None if x is NULL else float("nan") if x is NAN else x for x in place)


class _Lists:
    """The rows of a bucket in order of key and position, in lists that an index knows the ends of.

    Each is stored as one pickled value, a list by columns: Spark would walk arrays element by
    element.
    """

    def __init__(self, index, lists) -> None:
        self.index, self.lists = index, lists

    def load(self) -> list[dict]:
        found = self.index.get()
        if found is None:
            return []
        return [
            {"id": n, "place": _place(p), "first": f, "last_place": _place(q), "last": v}
            for n, p, f, q, v in pickle.loads(found[0])]

    def save(self, entries: list[dict]) -> None:
        self.index.update((pickle.dumps([
            (e["id"], _position(e["place"]), e["first"], _position(e["last_place"]), e["last"])
            for e in entries]),))

    def rows(self, number: int) -> dict[tuple, object]:
        *columns, values = pickle.loads(self.lists.getValue((number,))[0])
        return dict(zip(map(_place, zip(*columns, strict=True)), values, strict=True))

    def put(self, number: int, rows: list[tuple[tuple, object]]) -> dict:
        columns = zip(*[(*_position(p), v) for p, v in rows], strict=True)
        self.lists.updateValue((number,), (pickle.dumps([*columns]),))
        return {"id": number, "place": rows[0][0], "first": rows[0][1],
                "last_place": rows[-1][0], "last": rows[-1][1]}


class PreviousRow(StatefulProcessor):
    """For every row the one before it in its key, and again where a late row comes between.

    Input rows: the bucket, the keys, the order (its first column a whole number), the value;
    output rows have no bucket but ``prev_at`` (the first order column) and ``prev`` (the
    value). A row at a position that is known replaces that row.
    """

    def __init__(self, names: list[str], keys: int, size: int) -> None:
        self.row, self.keys, self.size = Row(*names), keys, size

    def init(self, handle) -> None:
        self.kept = _Lists(
            handle.getValueState("index", "entries binary"),
            handle.getMapState("lists", "id int", "rows binary"))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        keys = self.keys
        fresh = {}
        for row in rows:  # of one bucket in one batch; of equal positions the least value counts
            _, *position, value = row
            place = _place(position)
            if place not in fresh or _place((value,)) < _place((fresh[place],)):
                fresh[place] = value
        entries = self.kept.load()
        begins = [e["place"] for e in entries]
        dealt: dict[int, dict] = {}
        for place, value in fresh.items():
            at = max(bisect_right(begins, place) - 1, 0)
            dealt.setdefault(at, {})[place] = value
        number = max((e["id"] for e in entries), default=-1) + 1
        out: dict[tuple, tuple] = {}
        for at in sorted(dealt, reverse=True):  # from the end: places before it stay
            own = dealt[at]
            known = self.kept.rows(entries[at]["id"]) if entries else {}
            merged = sorted({**known, **own}.items(), key=itemgetter(0))
            of, before = None, (None, None)  # the key and the row before
            if at:
                place = entries[at - 1]["last_place"]
                of, before = place[:keys], (place[keys], entries[at - 1]["last"])
            changed = False
            for place, value in merged:
                if place[:keys] != of:
                    of, before, changed = place[:keys], (None, None), False
                mine = place in own
                if mine or changed:
                    out[place] = (value, *before)
                changed = mine
                before = (place[keys], value)
            if changed and at + 1 < len(entries):
                after = entries[at + 1]  # the next list begins right behind a fresh row
                if after["place"][:keys] == of:
                    out[after["place"]] = (after["first"], *before)
            parts = [merged[i : i + self.size // 2] for i in range(0, len(merged), self.size // 2)
                     ] if len(merged) > self.size else [merged]
            ids = [entries[at]["id"] if entries else number]
            number += 0 if entries else 1
            for _ in parts[1:]:
                ids.append(number)
                number += 1
            entries[at : at + 1] = [
                self.kept.put(n, part) for n, part in zip(ids, parts, strict=True)]
        self.kept.save(entries)
        for place, (value, since, last) in out.items():
            at, = _position((since,))
            yield self.row(*_position(place), value, at, last)

    def close(self) -> None:
        pass


def _types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    return {c: df.schema[c].dataType.simpleString() for c in columns}


def _ddl(types: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in types.items())


def _numbered(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """The columns and the value; timestamps among the columns as microseconds."""
    types = _types(df, columns)
    return df.select(
        *[F.unix_micros(c).alias(c) if types[c] == "timestamp" else F.col(c) for c in columns],
        value,
    )


def _at(types: dict[str, str], column: str, name: str) -> Column:
    found = F.col(name)
    return F.timestamp_micros(found) if types[column] == "timestamp" else found


def previous_rows(
    polls: DataFrame, keys: list[str], order: list[str], value: str, size: int = LIST_ROWS
) -> DataFrame:
    """The stream's rows with ``prev_<order[0]>`` and ``prev_<value>``, as far as is known.

    The streaming twin of ``ordered.previous_values``: a row is sent again when a late row
    comes between it and the one before. Keys and order are plain values. The keys are dealt to
    BUCKETS; a bucket's rows lie by key and order in lists of ``size`` rows at most, of which a
    batch opens those its rows fall into. A key with many rows has lists of its own.
    """
    types = _types(polls, [*keys, *order, value])
    rows = _numbered(polls, [*keys, *order], value)
    inner = _types(rows, [*keys, *order, value])
    sent = {**inner, "prev_at": inner[order[0]], "prev": inner[value]}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias(BUCKET)
    found = rows.select(bucket, "*").groupBy(BUCKET).transformWithState(
        PreviousRow(list(sent), len(keys), size), _ddl(sent), "Append", "None")
    return found.select(
        *[_at(types, c, c).alias(c) for c in [*keys, *order]],
        value,
        _at(types, order[0], "prev_at").alias(f"prev_{order[0]}"),
        F.col("prev").alias(f"prev_{value}"),
    )
