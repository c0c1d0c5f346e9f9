from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedmill.operators import joins
from feedmill.operators.keys import late_keys


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def facts(spark):
    # Half of all facts share code 'hot'; 'gone' has no dimension row.
    codes = ["hot"] * 500 + ["cold"] * 200 + ["gone"] * 200 + [None] * 100
    return spark.createDataFrame(list(enumerate(codes)), "id long, code string")


@pytest.fixture
def dimension(spark):
    rows = [("hot", "H", 1), ("cold", "C1", 1), ("cold", "C2", 1), ("cold", "C3", 0), ("gone", "G", 0)]
    return spark.createDataFrame(rows, "dim_code string, label string, in_use int")


def test_left_join_active(facts, dimension):
    got = joins.left_join_active(facts, dimension, F.col("code") == F.col("dim_code"), F.col("in_use") == 1)
    counts = Counter((r.code, r.label) for r in got.collect())
    assert counts == {("hot", "H"): 500, ("cold", "C1"): 200, ("cold", "C2"): 200, ("gone", None): 200, (None, None): 100}


@pytest.mark.parametrize("block", [1, 3, 100, 100_000])
def test_repeat_per_match_is_a_left_join(spark, facts, dimension, block):
    got = joins.repeat_per_match(dimension.select("dim_code", "label"), facts, "dim_code", "code", block)
    want = dimension.join(facts, F.col("dim_code") == F.col("code"), "left").select("dim_code", "label")
    assert Counter(got.collect()) == Counter(want.collect())
    back = joins.repeat_per_match(facts, dimension, "code", "dim_code", block)
    want = facts.join(dimension, F.col("dim_code") == F.col("code"), "left").select("id", "code")
    assert Counter(back.collect()) == Counter(want.collect())


def test_only_counts_of_the_right_side_are_shuffled(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 3).alias("k"), F.lit("x").alias("pad")).write.parquet(str(tmp_path / "r"))
    left = spark.range(5).withColumnRenamed("id", "l")
    text = plan(joins.repeat_per_match(left, spark.read.parquet(str(tmp_path / "r")), "l", "k"))
    assert "partial_count" in text and "ReadSchema: struct<k:bigint>" in text


def test_allow_lists(spark, facts):
    listed = spark.createDataFrame([("cold",), ("cold",), ("gone",)], "c string")
    assert joins.only_listed(facts, "code", listed).count() == 400
    assert joins.only_codes(facts, "code", "cold:gone").count() == 400
    assert joins.only_codes(facts, "code", "").count() == 1000


def test_a_hot_key_is_split_in_a_shuffled_join(spark, tmp_path):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000)
        left = spark.range(0, 100_000, 1, 8).select("id", key.alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        dim = spark.range(1000).select(F.col("id").alias("dim"), F.lit(1).alias("in_use"), F.lit("x").alias("label"))
        joined = joins.left_join_active(left, dim, F.col("code") == F.col("dim"), F.col("in_use") == 1)
        joined.write.parquet(str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 100_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_late_keys(spark):
    source = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 9)], "k long")
    exported = spark.createDataFrame([(k,) for k in (2, 5)], "k long")
    assert sorted(r.k for r in late_keys(source, exported, "k", 5).collect()) == [1, 3, 4]
    assert sorted(r.k for r in late_keys(source, exported, "k", 5, after=1).collect()) == [3, 4]
