"""Every registered query against its check SQL, and the shape of the plans."""

import os

import compare
import pytest

import __spark_entry__ as driver
from pollweave.plans.registry import registered

DATA = "/root/testdata"

QUERIES = {k: q for k, q in driver.queries().items() if k in registered()}
SQL = {k: sql for k, sql in driver.oracle_sql().items() if k in QUERIES}
SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    if key not in SQL:
        assert df.count() >= 0
        return
    names, found = compare.spark_rows(df)
    sql_names, expected = compare.sql_rows(con, SQL[key])
    assert names == sql_names and found == expected
    assert dict(df.dtypes) == compare.sql_types(con, SQL[key])


# Settings under which small tables take the way of large ones.
AS_IF_LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


@pytest.mark.parametrize(
    "key", ["entity_board", "contest_enrich", "poll_rows", "edges_in_layer", "edge_cull",
            "incident_edges", "radius_hit", "carry_forward", "delta_rate", "anti_fill"])
def test_query_without_broadcasts_and_with_hot_keys(spark, con, key):
    before = {k: spark.conf.get(k, None) for k in AS_IF_LARGE}
    try:
        for name, value in AS_IF_LARGE.items():
            spark.conf.set(name, value)
        _, found = compare.spark_rows(QUERIES[key](spark, SMALL))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert found == compare.sql_rows(con, SQL[key])[1]


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plan(spark, key, folder=SMALL):
    df = QUERIES[key](spark, folder)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_loops_over_all_pairs(spark):
    for key in QUERIES:
        if key.startswith("stream_"):
            continue
        text = plan(spark, key)
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text, key
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, key


def test_bounded_history_cuts_before_the_shuffle(spark):
    text = plan(spark, "retention_tail")
    assert "WindowGroupLimit" in text and "TakeOrderedAndProject" in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "level_round")
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in text
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in plan(
        spark, "self_links")


def test_latest_rows_are_combined_before_the_shuffle(spark):
    for key in ("priority_dedupe", "latest_record", "record_precedence", "field_precedence"):
        assert "partial_m" in plan(spark, key), key


def test_no_data_in_the_repository():
    for folder, _, files in os.walk(os.path.dirname(os.path.abspath(driver.__file__))):
        assert not any(f.endswith(".parquet") for f in files), folder
