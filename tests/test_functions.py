"""Hand-worked values for every edge of the column functions."""

import math

import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from pollweave.functions import falsy, fixed, metrics, normalize, rounding, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def column(spark, values, ddl, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    out = rows.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def variants(spark, texts, build):
    return column(spark, texts, "string", lambda v: build(F.parse_json(v)))


def test_polymorphic_codes(spark):
    codes = ["0", "1", '"2"', '"Terminids"', "9", '"9"', '""', "null", "2.5", "true", None]
    assert variants(
        spark, codes, lambda v: normalize.decode_variant(v, fixed.OWNER_CODES, "Unknown")
    ) == ["Humans", "Humans", "Terminids", "Terminids", "Unknown", "Unknown", "", "Unknown",
          "Unknown", "Humans", "Unknown"]
    # A sector string is a name even when it looks like a number.
    assert variants(
        spark, ["5", '"5"', "99", "null"],
        lambda v: normalize.decode_variant(v, fixed.SECTOR_CODES, "", decode_text=False),
    ) == ["Canopus", "5", "", ""]
    assert column(
        spark, ["2", "02", "x", "99999999999999999999", "", None], "string",
        lambda v: normalize.decode_code(v, fixed.OWNER_CODES, "Unknown"),
    ) == ["Terminids", "Terminids", "x", "Unknown", "", "Unknown"]


def test_faction_alias(spark):
    shown = column(spark, ["Automaton", "Automatons", "Humans", None], "string",
                   normalize.canonical_faction)
    assert shown == ["Automatons", "Automatons", "Humans", None]


def test_epochs(spark):
    texts = ["0", "1724000000", "10000000000", "10000000001", "1724000000123",
             '"2024-08-18T16:53:20Z"', '""', "null", None, "1724000000.9"]
    assert variants(spark, texts, normalize.iso_variant) == [
        "1970-01-01T00:00:00Z", "2024-08-18T16:53:20Z", "2286-11-20T17:46:40Z",
        "1970-04-26T17:46:40Z", "2024-08-18T16:53:20Z", "2024-08-18T16:53:20Z", "", "", "",
        "2024-08-18T16:53:20Z"]
    assert one(spark, t=normalize.local_time(F.timestamp_seconds(F.lit(1724000000)))) == (
        "2024-08-19T00:53:20+08:00",)


def test_falsy(spark):
    row = one(
        spark,
        zero=falsy.first_number(F.lit(0), F.lit(4)),
        null=falsy.first_number(F.lit(None).cast("int"), F.lit(0), F.lit(7)),
        last=falsy.first_number(F.lit(0), F.lit(0)),
        text=falsy.first_text(F.lit(""), F.lit("a")),
        array=falsy.first_array(F.array().cast("array<int>"), F.array(F.lit(1))),
        none=falsy.first_array(F.lit(None).cast("array<int>"), F.array(F.lit(2))),
    )
    assert row == (4, 7, 0, "a", [1], [2])
    assert variants(spark, ["[]", "[0]", "false", "0", '""', "{}", "null", "1", '"a"', None],
                    normalize.variant_truthy) == [
        False, True, False, False, False, False, False, True, True, False]


def test_progress(spark):
    progress = spark.createDataFrame(
        [(5, 0), (5, None), (20, 10), (-5, 10), (3, 8), (None, 8)], "cur int, max int"
    ).select(metrics.defender_progress(F.col("cur"), F.col("max")).alias("p")).collect()
    assert [r["p"] for r in progress] == [None, None, 0.0, 100.0, 62.5, None]
    spans = spark.createDataFrame(
        [(0, 10, 5), (10, 10, 5), (100, 50, 60), (1000, 173800, 500), (1000, 173800, 87400),
         (1000, 173800, 999999), (1000, 173800, 0)], "s long, e long, n long")
    rate = metrics.attacker_rate(F.col("s"), F.col("e"))
    out = spans.select(rate.alias("r"), metrics.attacker_progress(rate, F.col("s"), F.col("n")),
                       metrics.remaining(F.col("e"), F.col("n"))).collect()
    assert [tuple(r) for r in out] == [
        (None, None, 5), (None, None, 5), (None, None, 0), (2.083, None, 173300),
        (2.083, 49.99, 86400), (2.083, 100.0, 0), (2.083, None, None)]


def test_levels_and_rates(spark):
    assert column(spark, [0, None, 25000, 75000, 125000, 1000000], "long", metrics.level) == [
        None, None, 0, 2, 2, 20]
    row = one(
        spark,
        none=metrics.regen_percent(F.lit(2.0), F.lit(0)),
        some=metrics.regen_percent(F.lit(1.5), F.lit(2000000)),
        idle=metrics.regen_percent(F.lit(None).cast("double"), F.lit(10)),
    )
    assert row == (0.0, 0.27, 0.0)
    ratios = metrics.ratio_columns(
        F.lit(3), F.lit(0), F.lit(0), [F.lit(1), F.lit(None).cast("int")], F.lit(2))
    assert tuple(one(spark, **ratios)) == (None, None, None, None, 100.0, 0.0)


def test_contest_classes(spark):
    kinds = ["1", "4", "defense", "0", "2", None]
    assert column(spark, kinds, "string", metrics.contest_class) == [
        "defense", "defense", "defense", "liberation", "liberation", "liberation"]
    rows = spark.createDataFrame(
        [("1", None, 7), ("1", 1, 7), ("1", None, None), ("0", None, 7)],
        "k string, e int, id int")
    kind = metrics.with_recon(F.col("k"), F.col("e"), F.col("id"), metrics.contest_class(F.col("k")))
    assert [r[0] for r in rows.select(kind).collect()] == [
        "recon", "defense", "defense", "liberation"]


def test_bands(spark):
    rows = spark.createDataFrame([(0, 10), (-3, 10), (1, 0), (25, 100), (26, 100), (50, 100),
                                  (51, 100), (300, 100)], "c int, m int")
    percent = metrics.health_percent(F.col("c"), F.col("m"))
    out = rows.select(percent, metrics.progress_band(percent)).collect()
    assert [tuple(r) for r in out] == [
        (0.0, None), (0.0, None), (0.0, None), (25.0, "#ef4444"), (26.0, "#f59e0b"),
        (50.0, "#f59e0b"), (51.0, "#22c55e"), (100.0, "#22c55e")]


def test_delta(spark):
    rows = spark.createDataFrame(
        [(1.0, None, 1.0), (5.0, 5.005, 1.0), (5.0, 4.0, 0.0), (5.0, 4.0, 0.5), (4.0, 5.5, 1.0)],
        "v double, b double, h double")
    out = rows.select(metrics.delta_per_hour(F.col("v"), F.col("b"), F.col("h"))).collect()
    assert [r[0] for r in out] == [None, None, None, 2.0, -1.5]


def test_names(spark):
    assert column(spark, ["PLANET_3", "", None, "Alpha"], "string", normalize.is_stand_in) == [
        True, True, True, False]


def test_summary(spark):
    def lines(state, maximum):
        return one(spark, s=text.summary(
            F.lit("Alpha"), F.lit("Automaton"), F.lit(state).cast("string"), F.lit("Core"),
            F.lit(1), F.lit(maximum), F.lit(None).cast("int")))["s"].split("\n")

    assert lines(None, 3) == ["📍 Alpha", "阵营: 机器人", "星区: Core", "健康度: 33.33%", "玩家: 0"]
    assert lines("defense", 0)[2] == "战况: 防御战" and lines("defense", 0)[4] == "健康度: --%"
    assert lines("recon", 0)[2] == "战况: 解放战"


def test_display_tables(spark):
    def shown(build, *keys):
        return column(spark, list(keys), "string", build)

    assert shown(text.owner_colour, "Humans", "Automaton", None) == ["#3b82f6", "#64748b", "#64748b"]
    assert shown(text.contest_colour, "Automaton", "Automatons", "x") == [
        "#ef4444", "#ef4444", "#94a3b8"]
    assert shown(text.race_colour, "1", "4", "9") == ["#f59e0b", "#3b82f6", None]
    assert shown(text.sector_colour, "寂域", "x") == ["rgba(16, 185, 129, 1)", "rgba(100, 116, 139, 1)"]
    assert shown(text.weapon_class, "SMG", "x") == ["冲锋枪", None]


HARD = [2.5, 2.675, 0.125, 0.375, 1.005, 28.385, 28.384999999999998, -2.675, -0.125, 0.045,
        1e10 + 0.125, 12.345, 99.995, 0.0, -0.004, 33.333333333333336, 1234567.885]


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_rounding_of_the_exact_value(spark, digits):
    found = column(spark, HARD, "double", lambda v: rounding.half_even(v, digits))
    assert found == [round(x, digits) for x in HARD]


def test_half_up_differs_at_exact_ties_only(spark):
    assert column(spark, [0.125, 2.675, 0.375, 1.0], "double",
                  lambda v: rounding.half_up(v, 2)) == [0.13, 2.67, 0.38, 1.0]


@settings(max_examples=5, deadline=None)
@given(hs.lists(hs.one_of(
    hs.floats(-1e9, 1e9, allow_nan=False),
    hs.integers(-10**9, 10**9).map(lambda n: n / 1000),
    hs.integers(-10**6, 10**6).map(lambda n: n / 8),
), min_size=300, max_size=300))
def test_rounding_property(spark, values):
    found = column(spark, values, "double", lambda v: rounding.half_even(v, 2))
    assert all(a == b or math.isclose(a, 0) and math.isclose(b, 0)
               for a, b in zip(found, (round(v, 2) for v in values)))
