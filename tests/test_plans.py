"""Plans: what reaches the scan, and that no row passes through Python."""

import pytest

from feedmill.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan(text, table):
    return next(row for row in text.splitlines() if "FileScan" in row and f"{table}.parquet" in row)


@pytest.fixture
def wide_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_key_range_and_active_rows_reach_the_scan(spark, wide_plans):
    text = plan(QUERIES["incremental_export"](spark, SF_DIR))
    facts = scan(text, "orders")
    assert "GreaterThan(o_orderkey,0)" in facts and "LessThanOrEqual(o_orderkey," in facts
    assert "o_orderpriority" not in facts
    assert "EqualTo(c_mktsegment,BUILDING)" in scan(text, "customer")
    assert "EqualTo(n_regionkey,1)" in scan(text, "nation")
    assert text.count("LeftOuter") == 2


def test_columns_are_pruned(spark, wide_plans):
    assert "ReadSchema: struct<l_partkey:bigint>" in plan(QUERIES["left_join_multiplicity"](spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan(QUERIES["time_text"](spark, SF_DIR))
    events = scan(plan(QUERIES["stale_source"](spark, SF_DIR)), "events")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in events and "GreaterThan(ts," in events


def test_lines_are_split_once(spark):
    text = plan(QUERIES["fixed_layout_wide"](spark, SF_DIR))
    assert text.count("split(") == 1
    assert "Exchange" not in text
