"""Volume, freshness and silent sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from feedmill.operators import checks
from feedmill.registry.base import query
from feedmill.sources.relational import read_table, register_tables
from feedmill.spec import CheckSpec

NOW = datetime(2024, 1, 30, 12, 0, 0)
SIX_HOURS = 360
MONTH = 30 * 24 * 60
VOLUME_CHECKS = [
    CheckSpec("events_recent", "events", "ts", SIX_HOURS, 1000),
    CheckSpec("events_month", "events", "ts", MONTH, 1000),
    CheckSpec("orders_recent", "orders", "o_orderdate", SIX_HOURS, 1000),
    CheckSpec("unused", "orders", "o_orderdate", SIX_HOURS, 1000, enabled=False),
]


def _volume_sql(name: str, table: str, column: str, minutes: int) -> str:
    return f"""
        SELECT '{name}' AS check_name, count(*) AS observed, CAST(1000 AS BIGINT) AS min_rows, count(*) >= 1000 AS ok
        FROM {table} WHERE {column} > TIMESTAMP '{NOW}' - INTERVAL {minutes} MINUTE AND {column} < TIMESTAMP '{NOW}'
    """


@query(" UNION ALL ".join(_volume_sql(c.name, c.table, c.time_column, c.minutes) for c in VOLUME_CHECKS if c.enabled))
def volume_check(spark, sf_dir):
    register_tables(spark, sf_dir, "events", "orders")
    return checks.volume_check(spark, VOLUME_CHECKS, NOW)


@query(
    """
    SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest,
           max(ts) >= TIMESTAMP '2024-01-30 23:45:00' AS ok
    FROM events GROUP BY event_type
    UNION ALL SELECT 'never_sent', NULL, false
    """
)
def freshness_check(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    expected = events.select("event_type").distinct().union(spark.range(1).select(F.lit("never_sent")))
    result = checks.freshness_check(events, "event_type", "ts", datetime(2024, 1, 31), 15, expected)
    return result.withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
      SELECT user_id FROM events
      WHERE ts > TIMESTAMP '2024-01-30 06:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00')
    """
)
def stale_source(spark, sf_dir):
    customers = read_table(spark, sf_dir, "customer").select("c_custkey")
    events = read_table(spark, sf_dir, "events")
    return checks.stale_sources(customers, "c_custkey", events, "user_id", "ts", NOW, SIX_HOURS)
