import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedmill.operators.chunks import PARTITION_SHIFT, chunk_column, manifest, number_rows, part_column


def chunk_sizes(spark, n, per_file):
    df = spark.range(n).withColumn("t", F.col("id") % 7)
    numbered = number_rows(df, ("t", "id"))
    chunked = numbered.rows.withColumn("chunk", chunk_column(per_file))
    sizes = {r.chunk: r.rows for r in manifest(chunked, "id").collect()}
    assert numbered.total() == n
    numbered.release()
    return sizes


@pytest.mark.parametrize(
    "n, want", [(0, {}), (1, {0: 1}), (9, {0: 9}), (10, {0: 10}), (11, {1: 10, 2: 1}), (20, {1: 10, 2: 10})]
)
def test_sizes(spark, n, want):
    assert chunk_sizes(spark, n, 10) == want


def test_unsplit(spark):
    assert chunk_sizes(spark, 25, 0) == {0: 25}


def skewed(spark, n=9000):
    """A third of the rows share one sort value, another third have none."""
    rng = random.Random(1)
    values = ["hot"] * (n // 3) + [None] * (n // 3) + [f"v{rng.randint(0, 500)}" for _ in range(n // 3)]
    rng.shuffle(values)
    return spark.createDataFrame(list(enumerate(values)), "id long, v string"), values


def test_numbers_are_those_of_a_global_sort(spark):
    df, values = skewed(spark)
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or "", i))
    got = number_rows(df, ("v", "id")).rows.orderBy("rn").collect()
    assert [r.id for r in got] == order
    assert [r.rn for r in got] == list(range(1, len(values) + 1))


def test_a_hot_value_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df, _ = skewed(spark)
        numbered = number_rows(df, ("v", "id"))
        staged = spark.read.parquet(f"{numbered.stage}/rows").where("v = 'hot'")
        parts = staged.select(F.shiftright("_pos", PARTITION_SHIFT)).distinct().count()
        largest = numbered.segments.agg(F.max("_n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts >= 2
    assert largest < 9000 * 0.4


def test_groups_are_numbered_on_their_own(spark):
    df, values = skewed(spark)
    rows = number_rows(df, ("id",), ("v",)).rows.withColumn("chunk", part_column(1000)).collect()
    members = {}
    for i, v in enumerate(values):
        members.setdefault(v, []).append(i)
    for r in rows:
        place = members[r.v].index(r.id) if len(members[r.v]) < 50 else None
        assert place is None or r.rn == place + 1
        assert r.group_rows == len(members[r.v])
        assert r.chunk == (r.rn - 1) // 1000 + 1
    hot = sorted((r.rn, r.id) for r in rows if r.v == "hot")
    assert [i for _, i in hot] == members["hot"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_counts_meet_in_one_task(spark):
    df, _ = skewed(spark)
    numbered = number_rows(df, ("v", "id"))
    text = plan(numbered.rows)
    assert "SinglePartition" not in text and "Window" not in text
    assert text.count("Exchange") == text.count("BroadcastExchange")


def test_many_segments_are_joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, values = skewed(spark)
        numbered = number_rows(df, ("v", "id"))
        assert "SortMergeJoin" in plan(numbered.rows)
        assert sorted(r.rn for r in numbered.rows.collect()) == list(range(1, len(values) + 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from([None, "a", "b", "hot"]), st.none() | st.integers(-3, 3)), min_size=1, max_size=400),
    st.integers(1, 50),
)
def test_numbering_property(spark, cells, per_file):
    rows = [(i, g, v) for i, (g, v) in enumerate(cells)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = number_rows(df, ("v", "id"), ("g",)).rows.withColumn("chunk", chunk_column(per_file)).collect()
    want = {}
    for i, g, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or 0, r[0])):
        want.setdefault(g, []).append(i)
    assert len(got) == len(rows)
    for r in got:
        assert want[r.g][r.rn - 1] == r.id and r.group_rows == len(want[r.g])
        assert r.chunk == (0 if len(want[r.g]) <= per_file else (r.rn - 1) // per_file + 1)
