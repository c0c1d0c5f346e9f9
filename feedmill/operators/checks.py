"""Health checks over feeds; each returns rows, delivery of alerts is up to the caller.

The check time ``now`` is always an argument, so a check can be repeated.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.session import fresh_dir
from feedmill.spec import CheckSpec

# Windows that go back, each eight times as far as the one before it, before the rest of the past is read at once.
STEPS, FACTOR = 3, 8


def recent(time: Column, now: datetime, minutes: int) -> Column:
    """now - minutes < time < now, in a form that reaches the scan whatever the time type."""
    return (time > F.lit(str(now - timedelta(minutes=minutes)))) & (time < F.lit(str(now)))


def volume_check(spark: SparkSession, checks: list[CheckSpec], now: datetime) -> DataFrame:
    """Rows that arrived in each check's window against the least expected; one row per check."""
    results = [
        spark.table(c.table)
        .where(recent(F.col(c.time_column), now, c.minutes))
        .agg(F.count(F.lit(1)).alias("observed"))
        .select(
            F.lit(c.name).alias("check_name"),
            "observed",
            F.lit(c.min_rows).cast("long").alias("min_rows"),
            (F.col("observed") >= c.min_rows).alias("ok"),
        )
        for c in checks
        if c.enabled
    ]
    none = spark.createDataFrame([], "check_name string, observed long, min_rows long, ok boolean")
    return reduce(DataFrame.unionByName, results) if results else none


def newest_by_steps(df: DataFrame, feed: str, time: str, now: datetime, minutes: int, expected: DataFrame) -> DataFrame:
    """Newest time, up to ``now``, of each expected feed that has any.

    Reads the last ``minutes`` for all feeds, then windows that reach back ever further, each only for feeds not seen yet, and at
    last whatever is older. A window reaches the scan, so that files and row groups outside of it are not read; where all
    feeds are alive, that is all but the first.
    """
    spark, stage = df.sparkSession, fresh_dir(df.sparkSession, "newest")
    missing = expected.select(F.col(feed).alias("_feed")).distinct()
    reach, until, kinds = timedelta(minutes=minutes), F.lit(str(now)), None
    for step in range(STEPS + 1):
        since = now - reach
        window = F.col(time) <= until if step == 0 else F.col(time) < until
        if step < STEPS:
            window = window & (F.col(time) >= F.lit(str(since)))
        found = df.where(window).join(missing, F.col(feed) == F.col("_feed"), "left_semi").groupBy(feed).agg(F.max(time).alias("newest"))
        found.write.parquet(f"{stage}/step={step}")
        kinds = found.schema
        missing = missing.join(spark.read.schema(kinds).parquet(f"{stage}/step={step}"), F.col("_feed") == F.col(feed), "left_anti")
        if missing.isEmpty():
            break
        until, reach = F.lit(str(since)), reach * FACTOR
    return spark.read.schema(kinds).parquet(stage).select(*kinds.names)


def freshness_check(
    df: DataFrame, feed: str, time: str, now: datetime, minutes: int, expected: DataFrame | None = None
) -> DataFrame:
    """Newest time per feed, and whether it is within ``minutes`` of now.

    ``expected`` lists the feeds (a column ``feed``) of which each gets a row: one that never sent anything fails. With it
    times after ``now`` do not count, and only as much of the past is read as it takes to see every feed; without it the
    feeds are those of all times.
    """
    if expected is None:
        newest = df.groupBy(feed).agg(F.max(time).alias("newest"))
    else:
        newest = newest_by_steps(df, feed, time, now, minutes, expected)
        newest = expected.select(feed).distinct().join(newest, feed, "left")
    return newest.withColumn("ok", F.coalesce(F.col("newest") >= F.lit(str(now - timedelta(minutes=minutes))), F.lit(False)))


def file_freshness(spark: SparkSession, root: str, day_format: str, pattern: str, now: datetime, minutes: int) -> DataFrame:
    """Newest matching file in today's folder; a folder without one gives one failing row."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/{now.strftime(day_format)}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "modificationTime timestamp")
    files = found.agg(F.max("modificationTime").alias("newest"))
    limit = F.lit(str(now - timedelta(minutes=minutes)))
    return files.withColumn("ok", F.coalesce(F.col("newest") >= limit, F.lit(False)))


def stale_sources(
    registered: DataFrame, code: str, beats: DataFrame, beat_code: str, time: str, now: datetime, minutes: int
) -> DataFrame:
    """Registered sources without a beat in the window.

    Beats are reduced to distinct codes before they are shuffled, however many one source sent.
    """
    heard = beats.where(recent(F.col(time), now, minutes)).select(F.col(beat_code).alias("_heard")).distinct()
    return registered.join(heard, F.col(code) == F.col("_heard"), "left_anti")
