import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from feedmill.operators import checks
from feedmill.spec import CheckSpec

NOW = datetime(2024, 1, 1, 12, 0, 0)


def beats(spark, minutes, kind="timestamp_ntz"):
    rows = [(f"s{i}", str(NOW - timedelta(minutes=m))) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "source string, ts string").withColumn("ts", F.col("ts").cast(kind))


def test_window_is_open_at_both_ends(spark):
    for kind in ("timestamp_ntz", "timestamp"):
        df = beats(spark, [0, 1, 9, 10, 11, -1], kind)
        assert [r.source for r in df.where(checks.recent(F.col("ts"), NOW, 10)).collect()] == ["s1", "s2"]


def test_window_reaches_the_scan(spark, tmp_path):
    beats(spark, [1]).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "b")).where(checks.recent(F.col("ts"), NOW, 10))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in text and "LessThan(ts," in text


def test_volume(spark):
    beats(spark, range(20)).createOrReplaceTempView("beats")
    specs = [
        CheckSpec("enough", "beats", "ts", 10, 9),
        CheckSpec("too_few", "beats", "ts", 10, 10),
        CheckSpec("off", "beats", "ts", 10, 10, enabled=False),
    ]
    got = {r.check_name: (r.observed, r.ok) for r in checks.volume_check(spark, specs, NOW).collect()}
    assert got == {"enough": (9, True), "too_few": (9, False)}
    assert checks.volume_check(spark, specs[2:], NOW).collect() == []


def test_freshness(spark):
    df = beats(spark, [4, 5, 6])
    got = {r.source: r.ok for r in checks.freshness_check(df, "source", "ts", NOW, 5).collect()}
    assert got == {"s0": True, "s1": True, "s2": False}


def test_stale_sources(spark):
    registered = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("never",)], "code string")
    got = checks.stale_sources(registered, "code", beats(spark, [1, 30, 2]), "source", "ts", NOW, 10)
    assert sorted(r.code for r in got.collect()) == ["never", "s1"]


def test_file_freshness(spark, tmp_path):
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    day = tmp_path / now.strftime("%Y%m%d")
    os.makedirs(day)
    (day / "other.txt").write_text("x")

    def check(minutes):
        return checks.file_freshness(spark, str(tmp_path), "%Y%m%d", "*.dat", now, minutes).first().ok

    assert check(5) is False
    (day / "A-1.dat").write_text("x")
    assert check(5) is True
    old = (datetime.now(timezone.utc) - timedelta(minutes=30)).timestamp()
    os.utime(day / "A-1.dat", (old, old))
    assert check(5) is False and check(60) is True


def test_newest_goes_back_only_as_far_as_it_must(spark, tmp_path):
    path = str(tmp_path / "beats")
    rows = [("a", 1), ("a", 500), ("b", 7), ("c", 90), ("d", 100_000), ("later", -3)]
    made = spark.createDataFrame([(s, NOW - timedelta(minutes=m)) for s, m in rows], "source string, ts timestamp_ntz")
    made.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(path)
    df = spark.read.parquet(path)
    expected = spark.createDataFrame([(s,) for s in ("a", "b", "c", "d", "later", "never")], "source string")
    got = {r.source: (r.newest, r.ok) for r in checks.freshness_check(df, "source", "ts", NOW, 5, expected).collect()}
    ages = {"a": 1, "b": 7, "c": 90, "d": 100_000}
    assert got == {s: (NOW - timedelta(minutes=ages[s]) if s in ages else None, ages.get(s, 9) <= 5) for s in (*ages, "later", "never")}
    # With all feeds alive nothing older than the first window is read.
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    few = df.where(F.col("ts") >= F.lit(str(NOW - timedelta(minutes=5)))).mapInArrow(count, df.schema)
    checks.freshness_check(few, "source", "ts", NOW, 5, expected.where("source = 'a'")).collect()
    assert read.value == 2
