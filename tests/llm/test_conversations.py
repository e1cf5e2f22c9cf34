import hashlib
import itertools
import random
import re
import zlib

import brute
import pytest

from pollweave.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        if not body:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("t" if body[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired lines) by dynamic programming over (turns read, state)."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    add = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]

    def inserted(layer):
        for _ in range(3):
            for q in range(4):
                if layer[q] is not None:
                    cost, audit, lines = layer[q]
                    to, role = add[q]
                    new = (cost + 2, audit + "I", [*lines, role + ":"])
                    if layer[to] is None or new[:2] < layer[to][:2]:
                        layer[to] = new
        return layer

    layer = inserted([(0, "", []), None, None, None])
    for (role, text), mark in zip(rows, marks, strict=True):
        after = [None] * 4
        for q in range(4):
            if layer[q] is None:
                continue
            cost, audit, lines = layer[q]
            ways = [(q, 3, "D", lines)]
            if mark not in "bd":
                more = 1 if mark == "t" else 0
                if role[:1] in step[q]:
                    ways.append((step[q][role[:1]], more, "K", [*lines, f"{role}:{text}"]))
                to, new = add[q]
                ways.append((to, 2 + more, "R", [*lines, f"{new}:{text}"]))
            for to, more, letter, kept in ways:
                one = (cost + more, audit + letter, kept)
                if after[to] is None or one[:2] < after[to][:2]:
                    after[to] = one
        layer = inserted(after)
    return min((x for x in (layer[0], layer[3]) if x is not None), key=lambda x: x[:2])


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        body = [r[1:] for r in found]
        marks = faults(body)
        initials = [r[:1] for r, _ in body]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(body, marks)
        out.append((conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal,
                    cost, audit, brute.sha256("\n".join(lines))))
    return sorted(out, key=brute.key)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def op12(llm, folder):
    return brute.rows(queries.op12_bidirectional(llm, folder).select(*COLUMNS))


def test_query_equals_dynamic_programming(llm):
    rows = brute.read("conversations")[["conv_id", "turn", "role", "text"]]
    found = op12(llm, brute.SMALL)
    assert found == expected(list(rows.itertuples(index=False, name=None)))
    assert len({r[7] for r in found}) > 5


SCHEMA = "conv_id long, turn long, role string, text string, g string, block string, place int"


def fixture():
    draw = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "Assistant"]
    texts = ["a.", "b!", "c", " \n", "", None, "d? \t", "é", "x y."]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(0, 9)):
            rows.append((conv, turn * draw.choice([1, 1, 2]), draw.choice(roles),
                         draw.choice(texts) if draw.random() < 0.5 else f"t{turn}."))
    rows += [(None, t, "user", f"{t}") for t in (None, 3, 1, None, 9)]
    rows += [(900, None, "assistant", "q."), (900, None, "user", "p")]
    rows += [(901, 2, "user", "same."), (901, 2, "user", "same."), (901, 2, "assistant", "same.")]
    # A conversation of a third of all rows, with a turn that repeats all over it.
    for turn in range(400):
        rows.append((77, turn, draw.choice(roles[:3] if turn % 7 else roles),
                     "again." if turn % 5 == 0 else f"{turn}" + draw.choice(".!?,")))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_hot_conversation_nulls_and_ties(llm, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = fixture()
    df = llm.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r[0]: r for r in op12(llm, str(tmp_path))}
    for row in expected(rows):
        assert found.pop(row[0]) == row
    assert not found


@pytest.mark.parametrize("rows", [
    [], [(1, 0, "user", "x" * 300_000 + ".")], [(1, None, None, None)]])
def test_empty_tables_and_single_turns(llm, tmp_path, rows):
    llm.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).write.parquet(
        str(tmp_path / "conversations.parquet"))
    assert op12(llm, str(tmp_path)) == expected(rows)


def test_search_equals_dynamic_programming():
    draw = random.Random(2)
    for _ in range(4000):
        turns = [(draw.choice("suat"), draw.choice("...tbd")) for _ in range(draw.randint(0, 9))]
        rows = [(initial, "") for initial, _ in turns]
        cost, audit, _ = cheapest(rows, [f for _, f in turns])
        assert conversations.repaired("".join(a + b for a, b in turns)) == (cost, audit), turns


def test_repaired_turns(llm):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    figures, words = conversations.report(df)
    found = [(r.place, r.edit, r.role, r.text)
             for r in conversations.repair(df, words).orderBy("place").collect()]
    assert found == [(0, "K", "user", "a."), (1, "I", "assistant", ""), (2, "K", "user", "b."),
                     (3, "K", "assistant", "c")]
    assert figures.first().cost == 3
