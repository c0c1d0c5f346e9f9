"""Equal-height key ranges, and asking the source for its highest key."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.plans.export import ExportRun, export_incremental, seed
from feedmill.registry.state import equal_height_ranges
from feedmill.sinks.ledger import Ledger
from feedmill.sources.relational import key_edges, range_predicates
from feedmill.spec import FeedSpec
from test_export import NOW


@pytest.mark.parametrize("above", [None, 3, 10**12])
@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_ranges_hold_every_row_once_and_evenly(spark, above, ranges):
    # Half of the keys are bunched, the rest far apart, some are missing.
    df = spark.range(2000).select("id", F.expr("CASE WHEN id % 100 = 7 THEN NULL WHEN id < 1000 THEN id ELSE id * id * id END").alias("k"))
    edges = key_edges(df, "k", ranges, above)
    predicates = range_predicates("k", edges, above)
    assert len(predicates) == len(edges) + 1 <= ranges
    got = reduce(DataFrame.union, [df.where(p).withColumn("r", F.lit(i)) for i, p in enumerate(predicates)])
    want = df if above is None else df.where(F.col("k") > above)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    sizes = [r["count"] for r in got.groupBy("r").count().collect()]
    if above != 10**12 and ranges > 1:
        assert max(sizes) <= 1.2 * sum(sizes) / ranges + 25


def test_one_key_with_most_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 800, 5).otherwise(F.col("id")).alias("k"))
    predicates = range_predicates("k", key_edges(df, "k", 10))
    assert sum(df.where(p).count() for p in predicates) == 1000 and len(predicates) < 10
    assert range_predicates("k", key_edges(df.limit(0), "k", 10)) == ["1 = 1"]


@pytest.mark.parametrize("shift", [0, 9_000_000])
def test_keys_beyond_a_long(spark, tmp_path, shift):
    # The cubes of the shifted keys do not fit a long; one key is missing, and some rows share theirs.
    keys = spark.range(4000).select(F.expr(f"IF(id = 5, NULL, id - id % 2 + {shift})").alias("o_orderkey"))
    keys.write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r) for r in equal_height_ranges(spark, str(tmp_path)).collect()] == [(8, 4000, 2000, True)]
    wide = F.col("o_orderkey").cast("decimal(38,0)")
    cubes = keys.select((wide * wide * wide).alias("k"))
    predicates = range_predicates("k", key_edges(cubes, "k", 8, 4), 4)
    assert len(predicates) == 8 and sum(cubes.where(p).count() for p in predicates) == cubes.where("k > 4").count()


def test_the_source_may_tell_its_highest_key(spark, tmp_path):
    asked = []

    def top(above):
        asked.append(above)
        return 30 if above is None or above < 30 else None

    spark.range(1, 31).createOrReplaceTempView("told")
    sql = "SELECT id FROM told WHERE id > :start_pkid AND id <= :end_pkid"
    feed = FeedSpec(name="told", table="no_such_view", key="id", sql=sql, order_by=("id",), top_key=top)
    ledger, run = Ledger(spark, str(tmp_path / "ledger")), ExportRun(out_dir=str(tmp_path / "out"), now=NOW)
    seed(spark, [feed], ledger)
    assert ledger.mark("told") == 30 and export_incremental(spark, feed, run, ledger) is None
    ledger.close("other", None, 10, 0, None)
    other = FeedSpec(**{**feed.__dict__, "name": "other"})
    assert export_incremental(spark, other, run, ledger) == 20
    assert asked == [None, 30, 10]
