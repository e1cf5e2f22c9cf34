"""Mixing sources to target weights: Sainte-Laguë quotas of blocks, seeded block selection.

The words of a source stand on one line, document after document, which is cut into blocks of
equal length (to one word). Blocks are allocated to sources by highest quotients, shard by
shard of the mix; a seeded permutation of the source's blocks says which blocks its seats are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pollweave.llm.common import staged
from pollweave.llm.ordering import ranged, running

BLOCK = 32  # words of a block
SHARDS = 8  # parts of the mix, each with quotas of its own
REPEATS = 3  # a source, and so each of its documents, is taken at most this often
SEED = "mix"

# Primes below 2**20. A source's step is the first that does not divide its number of blocks:
# there always is one, as their product is beyond any count.
STEPS = (1048573, 1048571, 1048559, 1048549, 1048517, 1048507, 1048447, 1048433)


def n_words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], repeats: int = REPEATS) -> DataFrame:
    """A written table of sources (g, source_size) with the words each should have in the mix.

    Sources in the order of ``g`` get the weights in turn and share the sum of all sizes. A
    target stops at ``repeats`` times its source's size, and the excess goes to the others by
    weight until none is above. Sources reach their stop in the order of size / weight, so
    running sums in that order tell which of them do: no round is repeated.
    """
    ordered = ranged(sources.withColumn("all", F.lit(0)), ["g"], "mix-sources")
    ranks = running(ordered, ["all"], F.lit(1), "rank").drop("place")
    weight = F.element_at(
        F.array(*[F.lit(int(w)).cast("long") for w in weights]),
        F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    weighed = staged(
        ranks.withColumn("weight", weight).withColumn(
            "filled", F.col("source_size") / F.col("weight")),
        "mix-weights")
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    by_stop = ranged(weighed, ["filled", "g"], "mix-stops")
    sums = running(by_stop, ["all"], F.col("source_size"), "size_before")
    sums = running(sums, ["all"], F.col("weight"), "weight_before")
    left = F.lit(total).cast("long") - repeats * F.col("size_before")
    level = left / (F.lit(all_weights).cast("long") - F.col("weight_before"))
    stops = level >= repeats * F.col("filled")
    found = staged(sums.withColumn("level", level).withColumn("stops", stops), "mix-levels")
    (level,) = found.where("not stops").agg(F.max("level")).first()
    target = F.when(F.col("stops"), (repeats * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * F.lit(level).cast("double"))
    return found.select("g", "source_size", target.alias("target"))


def quotas(
    sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, repeats: int = REPEATS
) -> DataFrame:
    """Sources (g, source_size, target) with n_blocks and ``seats``: blocks up to each shard.

    A source is worth target / block length blocks; the mix has the rounded sum of that, the
    first k shards k / shards of it. Seat j of a source has the quotient worth / (j + 1/2); the
    highest ones win, a tie goes to the source that comes first. A source has at most
    ``repeats`` seats a block; only where all sources are at that stop does the mix stay short.
    """
    size = F.col("source_size")
    n_blocks = F.when(size > 0, F.greatest(F.lit(1), F.floor(size / block + 0.5))).otherwise(0)
    counted = staged(
        sources.withColumn("n_blocks", n_blocks.cast("long")).withColumn(
            "worth", F.when(size > 0, F.col("target") * F.col("n_blocks") / size).otherwise(0.0)),
        "mix-worth")
    worth = F.sum(F.floor(F.col("worth") * 1024 + 0.5))
    count, parts = counted.agg(F.count("g"), F.coalesce(worth, F.lit(0))).first()
    blocks = (parts + 512) // 1024
    houses = [blocks * (k + 1) // shards for k in range(shards)]

    # Every source's rounded share errs by half a seat at most. So the divisors that give all
    # sources together at most, and at least, the wanted seats lie this far apart; only
    # the seats won between the two are in doubt, and these are ranked.
    def seats(house: int, more: int) -> Column:
        ratio = max(0.0, (house + more * (count / 2 + 1)) / max(parts / 1024, 1e-9))
        won = F.floor(F.col("worth") * ratio + 0.5)
        return F.least(won, repeats * F.col("n_blocks")).cast("long")

    sure = counted.withColumn("sure", F.array(*[seats(h, -1) for h in houses]))
    given = sure.agg(*[F.coalesce(F.sum(F.col("sure")[k]), F.lit(0)) for k in range(shards)])
    open_seats = [h - n for h, n in zip(houses, given.first(), strict=True)]
    ranges = F.array(*[
        F.when(seats(h, 1) > F.col("sure")[k],
               F.sequence(F.col("sure")[k], seats(h, 1) - 1))
        for k, h in enumerate(houses)
    ])
    doubtful = (
        sure.select("g", "worth", F.posexplode(ranges).alias("house", "seat"))
        .select("g", "worth", "house", F.explode("seat").alias("seat"))
        .select("g", "house", "seat", (-F.col("worth") / (F.col("seat") + 0.5)).alias("behind"))
    )
    ranked = running(
        ranged(staged(doubtful, "mix-doubtful"), ["house", "behind", "g", "seat"], "mix-ranked"),
        ["house"], F.lit(1), "rank")
    open_of = F.element_at(
        F.array(*[F.lit(n).cast("long") for n in open_seats]), F.col("house") + 1)
    won = ranked.where(F.col("rank") < open_of).groupBy(F.col("g").alias("of")).agg(
        *[F.count_if(F.col("house") == k).alias(f"won{k}") for k in range(shards)])
    both = sure.join(won, F.col("g") == F.col("of"), "left")
    return both.select(
        "g", "source_size", "target", "n_blocks",
        F.array(*[
            F.col("sure")[k] + F.coalesce(F.col(f"won{k}"), F.lit(0)) for k in range(shards)
        ]).alias("seats"),
    )


def _div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def _first_word(block: Column) -> Column:
    """Where a block begins: the first ``size % n`` blocks of a line are a word longer."""
    size, n = F.col("source_size"), F.col("n_blocks")
    return block * _div(size, n) + F.least(block, size % n)


def _block_of(word: Column) -> Column:
    size, n = F.col("source_size"), F.col("n_blocks")
    short, longer = _div(size, n), size % n
    edge = longer * (short + 1)
    return F.when(word < edge, _div(word, short + 1)).otherwise(
        longer + _div(word - edge, short))


def _seat(block: Column) -> Column:
    """The block's place in its source's seeded order, in which seats are filled."""
    n = F.col("n_blocks")
    step = F.coalesce(*[F.when(n % p != 0, F.lit(p)) for p in STEPS]).cast("long")
    return (block * step + F.col("shift")) % n


def _copies(block: Column) -> Column:
    """How often the mix holds a block: seats at its place in the first, second, ... round."""
    n, seats = F.col("n_blocks"), F.element_at("seats", -1)
    return F.greatest(_div(seats - _seat(block) + n - 1, n), F.lit(0).cast("long"))


def _words(block: Column) -> Column:
    """Words of the document in a block."""
    begin = F.greatest(_first_word(block), F.col("start"))
    return F.least(_first_word(block + 1), F.col("start") + F.col("size")) - begin


def mix(
    df: DataFrame,
    weights: Sequence[int],
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``df``: key, size, source_size, target, taken and what lies behind.

    ``size`` is the number of words; a null text has none. Sources by code point, a null
    source last, have ``weights`` in turn (``targets``) and quotas of blocks (``quotas``).
    A source's documents stand in a line by key (null first), equal keys by size; which of
    two equal rows comes first cannot be told from the result. ``taken`` counts the words in
    selected blocks, repeats included: at most ``repeats`` times the size, and 0 without words.
    An empty table gives no rows; other columns are not read. The same rows and seed give
    the same mix on every run.

    ``start``, ``n_blocks``, ``seats`` and ``shift`` are what ``schedule`` lists blocks from.
    """
    sized = staged(
        df.select(
            F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("g"),
            F.col(key).alias("key"),
            n_words(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    sources = staged(sized.groupBy("g").agg(F.sum("size").alias("source_size")), "mix-totals")
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "g")), 1, 15), 16, 10).cast("long")
    plan = quotas(targets(sources, weights, repeats), block, shards, repeats).select(
        "g", "source_size", "target", "n_blocks", "seats",
        F.when(F.col("n_blocks") > 0, shift % F.col("n_blocks")).otherwise(shift).alias("shift"))
    lines = ranged(sized, ["g", "key", "size"], "mix-lines")
    rows = running(lines, ["g"], F.col("size"), "start", staged(plan, "mix-plan"))
    words = F.aggregate(
        _blocks(), F.lit(0).cast("long"), lambda sum, b: sum + _copies(b) * _words(b))
    return rows.select(
        "key", "size", "source_size", "target",
        F.when(F.col("size") > 0, words).otherwise(0).cast("long").alias("taken"),
        "start", "n_blocks", "seats", "shift",
    )


def _blocks() -> Column:
    return F.sequence(
        _block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))


def schedule(mixed: DataFrame) -> DataFrame:
    """One row per copy of a document's part of a block: key, shard, seat, first_word, words.

    ``first_word`` counts within the document. Shards hold the seats in order of quotient.
    """
    cut = mixed.where("size > 0").withColumn("block", F.explode(_blocks()))
    copies = cut.withColumn("copies", _copies(F.col("block"))).where("copies > 0")
    round_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    seat = _seat(F.col("block")) + F.col("round") * F.col("n_blocks")
    seated = copies.withColumn("round", round_).withColumn("seat", seat)
    first = F.greatest(_first_word(F.col("block")) - F.col("start"), F.lit(0).cast("long"))
    return seated.select(
        "key",
        F.size(F.filter("seats", lambda s: s <= F.col("seat"))).alias("shard"),
        "seat",
        first.alias("first_word"),
        _words(F.col("block")).alias("words"),
    )
