"""Structure repair of conversations: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (turns read, state of the role grammar ``(s?(ua)+)?``); an edge keeps,
reroles, deletes or inserts a turn. A conversation of any length is cut into segments of at
most 512 turns. A segment inside its conversation is searched for every pair of states; such
segments are the turns of a shorter lattice that is searched in the same way, round by round,
until one is left. Then the states at the cuts are known and travel back down.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pollweave.llm.common import arrow_map, staged
from pollweave.llm.ordering import ranged, running, starts, whole_groups

SEGMENT_BITS = 9
SEGMENT = 1 << SEGMENT_BITS

# States: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
STATES = range(4)
KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ADDED = [2, 2, 3, 2]  # the state after an inserted or reroled turn
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
CLOSING = ["", "II", "I", ""]  # the insertions that end a conversation in each state
LEGAL = {"su", "ua", "au"}

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs
FINE, BLANK, DUPLICATE, CUT = ".", "b", "d", "t"  # the first fault of a turn
SPACE = " \t\n\x0b\x0c\r"


def _turn_edges(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """Edges (next state, cost, letter) over one turn, by state."""
    edges = []
    more = TRUNCATED if fault == CUT else 0
    for state in STATES:
        out = [(state, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            kept = KEPT[state].get(initial)
            if kept is not None:
                out.append((kept, more, "K"))
            else:
                out.append((ADDED[state], REROLE + more, "R"))
        edges.append(out)
    return edges


def search(
    layers: list, begin: int, ends: tuple, inserts: bool, trailing: bool
) -> tuple[int, str] | None:
    """The least cost from ``begin`` to one of ``ends`` behind the last layer, and its least audit.

    ``layers[i][state]`` lists (next state, cost, letter). No two audits of one lattice end in
    the same node at the same cost with one beginning the other (the rest would be insertions
    that cost nothing), so the least audit is made of least parts. Edges of cost 0 lead one
    layer on; equal costs are settled in that order, so a settled label is final.
    """
    n = len(layers)
    back: list[list[list]] = [[[] for _ in STATES] for _ in range(n + 1)]
    for i, layer in enumerate(layers):
        for state in STATES:
            for after, cost, letter in layer[state]:
                back[i + 1][after].append((i, state, cost, letter))
    inserted = [inserts and (i < n or trailing) for i in range(n + 1)]
    labels: tuple[dict, dict] = ({(0, begin): (0, "")}, {(n, e): (0, "") for e in ends})
    done: tuple[set, set] = (set(), set())
    heaps = ([(0, 0, begin)], [(0, -n, e) for e in ends])
    heapq.heapify(heaps[1])
    best = min((0 for node in labels[0] if node in labels[1]), default=None)

    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break  # every crossing of the best cost has been met
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heapq.heappop(heaps[side])
        node = (abs(at), state)
        if node in done[side]:
            continue
        done[side].add(node)
        i, word = node[0], labels[side][node][1]
        if side == 0:
            steps = [((i + 1, q), c, word + a) for q, c, a in layers[i][state]] if i < n else []
            if inserted[i]:
                steps.append(((i, ADDED[state]), INSERT, word + "I"))
        else:
            steps = [((j, q), c, a + word) for j, q, c, a in back[i][state]]
            if inserted[i]:
                steps += [((i, q), INSERT, "I" + word) for q in STATES if ADDED[q] == state]
        for to, more, audit in steps:
            label = (cost + more, audit)
            old = labels[side].get(to)
            if old is not None and old <= label:
                continue
            labels[side][to] = label
            if old is None or label[0] < old[0]:
                heapq.heappush(heaps[side], (label[0], to[0] if side == 0 else -to[0], to[1]))
            other = labels[1 - side].get(to)
            if other is not None and (best is None or label[0] + other[0] < best):
                best = label[0] + other[0]
    if best is None:
        return None
    return best, min(
        word + labels[1][node][1]
        for node, (cost, word) in labels[0].items()
        if node in labels[1] and cost + labels[1][node][0] == best
    )


def _layers(pattern: str) -> list:
    return [_turn_edges(pattern[i], pattern[i + 1]) for i in range(0, len(pattern), 2)]


@functools.lru_cache(maxsize=20_000)
def repaired(pattern: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; two characters a turn: initial and fault."""
    return search(_layers(pattern), 0, ENDS, True, True)


def _pairs(layers: list, inserts: bool) -> dict:
    """Cost and audit between all pairs of states over a segment; insertions precede turns."""
    found = {}
    for begin in STATES:
        for end in STATES:
            one = search(layers, begin, (end,), inserts, False)
            if one is not None:
                found[begin, end] = one
    return found


def _summary(pairs: dict) -> dict:
    """Costs (-1: no way) and ranks of audits, and the best end if the segment were alone."""
    ranks = {word: i for i, word in enumerate(sorted({w for _, w in pairs.values()}))}
    at = [(b, e) for b in STATES for e in STATES]
    ends = [(pairs[0, e][0] + INSERT * len(CLOSING[e]), pairs[0, e][1], e)
            for e in STATES if (0, e) in pairs]
    cost, _, end = min(ends)
    return {
        "costs": [pairs[p][0] if p in pairs else -1 for p in at],
        "ranks": [ranks[pairs[p][1]] if p in pairs else -1 for p in at],
        "cost": cost,
        "end": end,
    }


def _segment_edges(costs: list, ranks: list) -> list:
    return [
        [(e, costs[4 * b + e], chr(48 + ranks[4 * b + e])) for e in STATES if costs[4 * b + e] >= 0]
        for b in STATES
    ]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


SEGMENTS = (
    "g string, block long, whole boolean, word string, cost long, end int, costs array<long>, "
    "ranks array<int>, first string, last string, illegal long"
)
_NAMES = [c.strip().split(" ")[0] for c in SEGMENTS.split(",")]


def _columns(rows: list[dict]) -> dict:
    return {name: [r.get(name) for r in rows] for name in _NAMES}


def _turn_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Segments of turns; one with other conversations on both sides is whole."""
    for rows in whole_groups(batches, ["block"]):
        cuts, out = starts(rows, ["block", "g"]), []
        names, blocks, initials, faults = (
            rows[c].to_pylist() for c in ("g", "block", "initial", "fault"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            pattern = "".join(x or " " for p in zip(initials[a:b], faults[a:b]) for x in p)
            row = {"g": names[a], "block": blocks[a], "first": initials[a],
                   "last": initials[b - 1], "illegal": _illegal(initials[a:b])}
            row["whole"] = (
                a > 0 and b < len(names) and blocks[a - 1] == blocks[a] == blocks[b])
            if row["whole"]:
                row["cost"], row["word"] = repaired(pattern)
            else:
                row |= _summary(_pairs(_layers(pattern), True))
            out.append(row)
        yield _columns(out)


def _joined_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in whole_groups(batches, ["g", "block"]):
        cuts, out = starts(rows, ["g", "block"]), []
        every = rows.to_pylist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            parts = every[a:b]
            between = sum(
                x["last"] + y["first"] not in LEGAL for x, y in zip(parts, parts[1:], strict=False))
            layers = [_segment_edges(p["costs"], p["ranks"]) for p in parts]
            out.append({
                "g": parts[0]["g"], "block": parts[0]["block"], "whole": False,
                "first": parts[0]["first"], "last": parts[-1]["last"],
                "illegal": sum(p["illegal"] for p in parts) + between,
                **_summary(_pairs(layers, False)),
            })
        yield _columns(out)


def _turn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The audit of each segment of turns between the states that are its own."""
    for rows in whole_groups(batches, ["block", "g"]):
        cuts, words = starts(rows, ["block", "g"]), []
        initials, faults, begins, ends = (
            rows[c].to_pylist() for c in ("initial", "fault", "begin", "end"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            pattern = "".join(x or " " for p in zip(initials[a:b], faults[a:b]) for x in p)
            words.append(search(_layers(pattern), begins[a], (ends[a],), True, False)[1])
        first = rows.take(cuts[:-1])
        yield {"g": first["g"].combine_chunks(), "block": first["block"].combine_chunks(),
               "word": words}


def _segment_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The states at both ends of every part of a joined segment."""
    for rows in whole_groups(batches, ["g", "block"]):
        cuts, begins, ends = starts(rows, ["g", "block"]), [], []
        every = rows.to_pylist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            layers = [_segment_edges(p["costs"], p["ranks"]) for p in every[a:b]]
            state = every[a]["begin"]
            word = search(layers, state, (every[a]["end"],), False, False)[1]
            for layer, letter in zip(layers, word, strict=True):
                begins.append(state)
                state = next(e for e, _, own in layer[state] if own == letter)
                ends.append(state)
        yield {"g": rows["g"].combine_chunks(), "block": rows["part"].combine_chunks(),
               "begin": begins, "end": ends}


def _by_block(df: DataFrame, order: str) -> DataFrame:
    return df.repartition("g", "block").sortWithinPartitions("g", "block", order)


def named(key: Column) -> Column:
    """A conversation's name: equal for equal keys, empty for the null key."""
    return F.coalesce(F.concat(F.lit("c"), key.cast("string")), F.lit(""))


def _turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(
        named(F.col(key)).alias("g"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


# The order of a conversation's turns. Rows that agree in all of it are equal.
ORDER = ["turn", "role", "digest"]


def faults(df: DataFrame, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per turn without its text: g, turn, initial, fault and place, written once.

    ``fault`` is the first that counts: ``b`` blank, ``d`` role and text seen earlier in the
    conversation (texts by 128 bits), ``t`` truncated, else ``.``.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = staged(
        _turns(df, key, turn, role, text).select(
            "g", *ORDER,
            (trimmed == "").alias("blank"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        ),
        "turns")
    rows = ranged(narrow, ["g", *ORDER], "turn-order")
    firsts = rows.groupBy("g", "role", "digest").agg(F.min("place").alias("first")).select("first")
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(F.col("cut"), CUT).otherwise(FINE))
    return staged(
        rows.join(firsts, F.col("place") == F.col("first"), "left").select(
            "g", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
            "place"),
        "turn-faults")


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the rows of ``faults``: the audits by segment, and cost and illegal pairs by g.

    The first result has g, block and word; the words of a conversation in the order of block
    make its audit.
    """
    cut = rows.withColumn("block", F.shiftright("place", SEGMENT_BITS))
    segments = staged(
        arrow_map(
            cut.select("g", "block", "place", "initial", "fault")
            .repartition("block").sortWithinPartitions("block", "place"),
            _turn_segments, SEGMENTS),
        "segments")
    words = [segments.where("whole").select("g", "block", "word")]
    sums = [segments.where("whole").select("g", "cost", "illegal")]
    parts, rounds = segments.where("not whole"), []
    tops = []
    while True:
        several = staged(
            parts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
                F.col("g").alias("of")), "several")
        joined = parts.join(several, F.col("g") == F.col("of"), "left")
        tops.append(joined.where("of is null").select(
            "g", "block", F.lit(0).alias("begin"), "end", "cost", "illegal"))
        if several.isEmpty():
            break
        left = joined.where("of is not null").drop("of").withColumnRenamed("block", "part")
        if rounds:
            left = left.withColumn("n", F.col("part"))
        else:
            left = running(
                ranged(staged(left, "segments-left"), ["g", "part"], "segments-order"),
                ["g"], F.lit(1), "n")
        left = staged(
            left.withColumn("block", F.shiftright("n", SEGMENT_BITS)), "segments-round")
        rounds.append(left)
        parts = staged(
            arrow_map(
                _by_block(left.select("g", "block", "n", "costs", "ranks", "first", "last",
                                      "illegal"), "n"),
                _joined_segments, SEGMENTS),
            "segments-joined")
    sent = None
    for depth in range(len(tops) - 1, -1, -1):
        own = tops[depth].select("g", "block", "begin", "end")
        sent = own if sent is None else own.unionByName(sent)
        if depth:
            below = rounds[depth - 1].drop("end", "cost", "whole", "word")
            sent = staged(
                arrow_map(
                    _by_block(below.join(sent, ["g", "block"]), "n").select(
                        "g", "block", "part", "costs", "ranks", "begin", "end"),
                    _segment_ends, "g string, block long, begin int, end int"),
                "segment-ends")
    chosen = arrow_map(
        cut.join(sent, ["g", "block"]).repartition("block")
        .sortWithinPartitions("block", "place")
        .select("g", "block", "initial", "fault", "begin", "end"),
        _turn_words, "g string, block long, word string")
    closing = F.element_at(F.array(*[F.lit(c) for c in CLOSING]), F.col("end") + 1)
    after = F.lit((1 << 63) - 1).alias("block")
    for top in tops:
        sums.append(top.select("g", "cost", "illegal"))
        words.append(top.select("g", after, closing.alias("word")).where("word <> ''"))
    return (
        staged(functools.reduce(DataFrame.unionByName, [*words, chosen]), "turn-audits"),
        functools.reduce(DataFrame.unionByName, sums),
    )


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Audits, then the turns they are about, as repaired turns: one row per edit."""
    name, audit, at, state, place = None, "", 0, 0, 0
    words: list[str] = []

    def added(out: list) -> None:
        """The insertions that come next."""
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = ADDED[state]
            out.append((name, place, "I", ROLE[state], ""))
            at, place = at + 1, place + 1

    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("g", "word", "role", "text"))
        for g, word, role, text in zip(*columns, strict=True):
            if g != name:
                added(out)
                name, audit, at, state, place, words = g, "", 0, 0, 0, []
            if word is not None:
                words.append(word)
                continue
            if words:
                audit, words = "".join(words), []
            added(out)
            edit = audit[at]
            if edit == "R":
                state = ADDED[state]
                role = ROLE[state]
            elif edit == "K":
                state = KEPT[state][role[:1]]
            out.append((name, place, edit, role, text))
            at, place = at + 1, place + 1
        if out:
            yield dict(zip(("g", "place", "edit", "role", "text"), zip(*out, strict=True),
                           strict=True))
    out = []
    added(out)
    if out:
        yield dict(zip(("g", "place", "edit", "role", "text"), zip(*out, strict=True),
                       strict=True))


def repair(
    df: DataFrame, words: DataFrame, key="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """The edits of every conversation, in order: g, place, edit, role, text.

    Turns with the edit ``D`` are the deleted ones; the others are the repaired conversation.
    ``words`` are the audits of ``plan``. Turns stand by turn (null first), role and MD5 of the
    text. Texts move once, to the other turns of their conversation, and pass in a stream;
    conversations lie whole and in order in the partitions of the result.
    """
    rows = _turns(df, key, turn, role, text).withColumn("block", F.lit(None).cast("long"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(
        words.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("g").sortWithinPartitions("g", "kind", "block", *ORDER)
    return arrow_map(
        ordered.select("g", "word", "role", "text"), _applied,
        "g string, place long, edit string, role string, text string")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    name, edits, digest, between = None, [], hashlib.sha256(), b""
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("g", "edit", "role", "text"))
        for g, edit, role, text in zip(*columns, strict=True):
            if g != name:
                if name is not None:
                    out.append((name, "".join(edits), digest.hexdigest()))
                name, edits, digest, between = g, [], hashlib.sha256(), b""
            edits.append(edit)
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                between = b"\n"
        if out:
            yield dict(zip(("g", "audit", "sha256"), zip(*out, strict=True), strict=True))
    if name is not None:
        yield {"g": [name], "audit": ["".join(edits)], "sha256": [digest.hexdigest()]}


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation of ``repair``: g, audit, and the SHA-256 of its lines ``role:text``.

    A digest over a whole conversation is one pass: its edits go through one task as a stream.
    """
    return arrow_map(edits, _told, "g string, audit string, sha256 string")


def report(
    df: DataFrame, key="conv_id", turn="turn", role="role", text="text"
) -> tuple[DataFrame, DataFrame]:
    """Per conversation of ``df`` its figures, and the audits for ``repair``.

    The figures: g, gaps (missing turn numbers between the least and the largest; 0 if all are
    null), turns by first fault (blank, duplicate, truncated), illegal (neighbours whose
    initials are not su, ua or au), and the least cost. Keeping a turn costs nothing, a new
    role (user or assistant) 2, deleting 3, inserting 2, keeping a truncated turn 1 more; blank
    and repeated turns must go. Equal costs are decided by the least audit in ASCII. A null
    role or text is empty; a null key is a conversation of its own. Tables without rows give
    none; other columns are not read.
    """
    rows = faults(df, key, turn, role, text)
    words, sums = plan(rows)
    count = [F.count_if(F.col("fault") == f).alias(n)
             for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    # Turn numbers are made distinct first, so that a long conversation meets in few rows.
    found = rows.groupBy("g", "turn").agg(*count).groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast(
            "long").alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    return found.join(sums, "g"), words
