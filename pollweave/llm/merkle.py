"""Merkle manifests by time-forward processing: digests travel up, proofs travel down.

Nodes carry labels (level, index within the group), children before parents. A queue ordered
by label hands every node the digests of its children; then a sweep in the reversed order
hands every node the proof of its parent. A block, the 729 lowest nodes under one ancestor,
is swept within a task by a heap. Messages that leave a block travel in a shuffle sorted by
label, which spills like any sort: it is the external part of the queue. So each round goes
up or down six levels, and no group, however large, is in one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pollweave.llm.common import arrow_map, staged
from pollweave.llm.ordering import ranged, running, starts, whole_groups

RUN = 3  # consecutive nodes that become one
LEVELS = 6  # levels of a block
BLOCK = RUN**LEVELS

# A proof is a string: the levels from the leaf upwards, "/" between them. Each holds the
# digests of the run from left to right, with OWN in the place of the node itself.
OWN, NEXT = "_", "/"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        size = F.octet_length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to along ``proof``."""
    climbed = F.aggregate(
        F.split(proof, NEXT), leaf,
        lambda digest, level: F.sha2(F.replace(level, F.lit(OWN), digest), 256))
    return F.when(proof == "", leaf).otherwise(climbed)


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof, joined."""
    return F.translate(proof, OWN + NEXT, "")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _sweep_up(digests: list[str]) -> tuple[dict[tuple[int, int], list[str]], str, int]:
    """The runs below every inner node of a block by label, the top digest, its level.

    The queue holds (label of the parent, place in its run, digest).
    """
    queue = [((1, i // RUN), i % RUN, d) for i, d in enumerate(digests)]  # already a heap
    width, level = {0: len(digests)}, 0
    while width[level] > 1:
        width[level + 1] = -(-width[level] // RUN)
        level += 1
    runs: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue and level:
        label = queue[0][0]
        run = []
        while queue and queue[0][0] == label:
            run.append(heapq.heappop(queue)[2])
        runs[label] = run
        top = _digest("".join(run))
        if label[0] < level:
            parent = (label[0] + 1, label[1] // RUN)
            heapq.heappush(queue, (parent, label[1] % RUN, top))
    return runs, top, level


def _sweep_down(digests: list[str], proof: str) -> list[str]:
    """The proof of every node of a block whose top has ``proof``."""
    runs, _, level = _sweep_up(digests)
    found = [proof] * len(digests)
    queue = [(-level, 0, proof)]
    while queue and level:
        above, index, proof = heapq.heappop(queue)
        run = runs[-above, -index]
        for at in range(len(run)):
            own = "".join([*run[:at], OWN, *run[at + 1 :]]) + NEXT + proof
            child = -index * RUN + at
            if above == -1:
                found[child] = own
            else:
                heapq.heappush(queue, (above + 1, -child, own))
    return found


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes dealt by block, sorted by label within it."""
    cut = nodes.withColumn("block", F.floor(F.col("n") / BLOCK).cast("long"))
    return _sorted(cut)


def _sorted(cut: DataFrame) -> DataFrame:
    return cut.repartition("g", "block").sortWithinPartitions("g", "block", "n")


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in whole_groups(batches, ["g", "block"]):
        cuts = starts(rows, ["g", "block"])
        digests = rows["digest"].to_pylist()
        found = [_sweep_up(digests[a:b])[1:] for a, b in zip(cuts, cuts[1:], strict=False)]
        first = rows.take(cuts[:-1])
        yield {
            "g": first["g"].combine_chunks(),
            "n": first["block"].combine_chunks(),
            "digest": [d for d, _ in found],
            "level": [level for _, level in found],
        }


def _up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, lowest first, and the top node of each group."""
    rounds = []
    while True:
        rounds.append(nodes)
        tops = staged(
            arrow_map(
                _blocks(nodes.select("g", "n", "digest")), _tops,
                "g string, n long, digest string, level int"),
            "merkle-blocks",
        )
        if tops.where("n > 0").isEmpty():
            return rounds, tops.select("g", "digest")
        # Only the last block of a group can be lower than the others: one node runs up.
        shared = tops.where("n = 1").select(F.col("g").alias("shared"))
        steps = F.when(F.col("shared").isNull(), 0).otherwise(LEVELS - F.col("level"))
        risen = F.aggregate(
            F.array_repeat(F.lit(0), F.col("steps")), F.col("digest"),
            lambda digest, _: F.sha2(digest, 256))
        nodes = staged(
            tops.join(shared, F.col("g") == F.col("shared"), "left")
            .withColumn("steps", steps)
            .select("g", "n", "steps", risen.alias("digest")),
            "merkle-round",
        )


def _delivered(passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in whole_groups(batches, ["g", "block"]):
            cuts = starts(rows, ["g", "block"])
            digests, steps, tops = (
                rows[c].to_pylist() for c in ("digest", "steps", "proof"))
            proofs, subroots, roots = [], [], []
            sent = {c: rows[c].take(cuts[:-1]).to_pylist() for c in ("subroot", "root")}
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                # The first row of a block is the message from above.
                below = _sweep_down(digests[a + 1 : b], tops[a])
                proofs += [
                    (OWN + NEXT) * s + p for s, p in zip(steps[a + 1 : b], below, strict=True)]
                subroots += [sent["subroot"][i]] * len(below)
                roots += [sent["root"][i]] * len(below)
            kept = rows.filter(pc.greater_equal(rows["n"], 0))
            yield {
                **{c: kept[c].combine_chunks() for c in ["g", "n", "digest", *passed]},
                "proof": proofs, "subroot": subroots, "root": roots,
            }

    return run


def _down(rounds: list[DataFrame], messages: DataFrame, passed: list[str]) -> DataFrame:
    """The lowest nodes with their proofs; ``messages`` (g, n = 0, proof, subroot, root) start it."""
    for depth in range(len(rounds) - 1, -1, -1):
        nodes, keep = rounds[depth], passed if depth == 0 else []
        cut = nodes.withColumn("block", F.floor(F.col("n") / BLOCK).cast("long"))
        sent = messages.select(
            "g", F.col("n").alias("block"), F.lit(-1).cast("long").alias("n"), "proof", "subroot",
            "root")
        types = {f.name: f.dataType.simpleString() for f in nodes.schema}
        ddl = ", ".join(f"`{c}` {types[c]}" for c in ["g", "n", "digest", *keep])
        messages = arrow_map(
            _sorted(cut.unionByName(sent, allowMissingColumns=True)), _delivered(keep),
            f"{ddl}, proof string, subroot string, root string")
        if depth:
            messages = staged(messages, "merkle-proofs")
    return messages


def manifest(
    df: DataFrame,
    leaf: Column,
    key: str = "doc_id",
    group: str = "source",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``df``: key, leaf, subroot, root, proof, and the columns of ``carry``.

    The leaves of a group stand by key (null first), equal keys by leaf digest, equal rows in
    any order: each has a place and a proof of its own. Every three consecutive nodes become
    the SHA-256 of their joined digests, a last run may be shorter, until one is left: the
    subroot (a lone leaf is its group's subroot). The subroots, by group as UTF-8 bytes with
    the null group first, give the root in the same way. An empty table gives no rows. Only
    the columns that ``leaf``, ``key``, ``group`` and ``carry`` name are read.
    """
    carried = carry or {}
    extra = F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carried.items()])
    leaves = staged(
        df.select(
            F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("g"),
            F.col(key).alias("key"),
            leaf.alias("digest"),
            extra.alias("extra"),
        ),
        "merkle-leaves",
    )
    nodes = staged(
        running(ranged(leaves, ["g", "key", "digest"], "merkle-order"), ["g"], F.lit(1), "n")
        .drop("place")
        .withColumn("steps", F.lit(0)),
        "merkle-nodes",
    )
    rounds, subroots = _up(nodes)
    groups = ranged(subroots.select(F.lit("").alias("all"), "g", "digest"), ["g"], "merkle-groups")
    upper = staged(
        running(groups, ["all"], F.lit(1), "n").select(
            F.col("all").alias("g"), "n", F.lit(0).alias("steps"), "digest",
            F.col("g").alias("name")),
        "merkle-subroots",
    )
    above, root = _up(upper)
    first = root.select(
        "g", F.lit(0).cast("long").alias("n"), F.lit("").alias("proof"),
        F.lit("").alias("subroot"), F.col("digest").alias("root"))
    sent = _down(above, first, ["name"]).select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("n"), "proof",
        F.col("digest").alias("subroot"), "root")
    proof = F.regexp_replace("proof", f"{NEXT}$", "")
    return _down(rounds, staged(sent, "merkle-sent"), ["key", "extra"]).select(
        "key",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof.alias("proof"),
        *[F.col("extra")[n].alias(n) for n in carried],
    )
