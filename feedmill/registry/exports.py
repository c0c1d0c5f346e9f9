"""Exports: joins, order, rendering, catalogue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedmill.functions import columns as C
from feedmill.operators import joins, keys
from feedmill.operators.chunks import row_order
from feedmill.plans.export import ExportRun, export_incremental, feed_line, feed_rows, is_due, read_delivered, run_catalogue, seed
from feedmill.registry.base import query
from feedmill.session import fresh_dir
from feedmill.sinks.delimited import write_ordered
from feedmill.sinks.ledger import Ledger
from feedmill.sources.relational import read_table, register_tables
from feedmill.spec import FeedSpec

RUN_TIME = datetime(2024, 2, 1, 6, 30, 0)

ORDERS_FEED = FeedSpec(
    name="orders",
    table="orders",
    key="o_orderkey",
    sql="""
        SELECT date_format(d.o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS event_time, d.o_orderkey, d.o_orderstatus,
               cast(cast(d.o_totalprice AS decimal(18,2)) AS string) AS price, d.o_orderdate,
               c.c_name, cast(cast(c.c_acctbal AS decimal(18,6)) AS string) AS balance, n.n_name
        FROM orders d
        LEFT JOIN customer c ON d.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1
        WHERE d.o_orderkey > :start_pkid AND d.o_orderkey <= :end_pkid
    """,
    order_by=("o_orderdate", "o_orderkey"),
    columns=("event_time", "o_orderkey", "o_orderstatus", "price", "c_name", "balance", "n_name", "n_name"),
    chunk_rows=5000,
    file_name="ORDERS-[DT].dat",
)

CUSTOMER_FEED = FeedSpec(
    name="customer",
    sql="""
        SELECT c.c_custkey, c.c_name, c.c_mktsegment,
               cast(cast(c.c_acctbal AS decimal(18,6)) AS string) AS balance, n.n_name
        FROM customer c
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 2
        WHERE c.c_acctbal >= 0 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')
    """,
    order_by=("c_name", "c_custkey"),
    file_name="CUSTOMER-[DT].dat",
)

ORDERS_SQL = """
    SELECT d.o_orderkey, d.o_orderdate,
           strftime(d.o_orderdate, '%Y-%m-%d %H:%M:%S') || ',' || d.o_orderkey || ',' || d.o_orderstatus || ','
           || CAST(d.o_totalprice AS DECIMAL(18,2)) || ',' || coalesce(c.c_name, '') || ','
           || coalesce(CAST(CAST(c.c_acctbal AS DECIMAL(18,6)) AS VARCHAR), '') || ','
           || coalesce(n.n_name, '') || ',' || coalesce(n.n_name, '') AS line
    FROM orders d
    LEFT JOIN customer c ON d.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1
    WHERE d.o_orderkey > 0
"""


def export_run(spark, **settings) -> ExportRun:
    return ExportRun(out_dir=fresh_dir(spark, "export"), now=RUN_TIME, **settings)


def new_ledger(spark) -> Ledger:
    return Ledger(spark, fresh_dir(spark, "ledger"))


@query(f"SELECT o_orderkey, line FROM ({ORDERS_SQL})")
def incremental_export(spark, sf_dir):
    register_tables(spark, sf_dir, "orders", "customer", "nation")
    top = keys.max_key(spark.table("orders"), "o_orderkey")
    rows = feed_rows(spark, ORDERS_FEED, 0, top)
    run = ExportRun(out_dir="", now=RUN_TIME)
    return rows.select("o_orderkey", feed_line(ORDERS_FEED, rows, run).alias("line"))


@query(
    """
    SELECT c.c_custkey, c.c_name, c.c_mktsegment,
           CAST(CAST(c.c_acctbal AS DECIMAL(18,6)) AS VARCHAR) AS balance, n.n_name
    FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 2
    WHERE c.c_acctbal >= 0 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')
    ORDER BY c.c_name NULLS LAST, c.c_custkey
    """
)
def dim_export(spark, sf_dir):
    register_tables(spark, sf_dir, "customer", "nation")
    return feed_rows(spark, CUSTOMER_FEED).orderBy(*row_order(CUSTOMER_FEED.order_by))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name FROM lineitem
    LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 5
    """
)
def left_join_active(spark, sf_dir):
    joined = joins.left_join_active(
        read_table(spark, sf_dir, "lineitem"),
        read_table(spark, sf_dir, "supplier"),
        F.col("l_suppkey") == F.col("s_suppkey"),
        F.col("s_nationkey") < 5,
    )
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name")


@query(
    """
    SELECT n_nationkey, n_name, c_custkey
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'
    """
)
def left_join_fan_out(spark, sf_dir):
    joined = joins.left_join_active(
        read_table(spark, sf_dir, "nation"),
        read_table(spark, sf_dir, "customer"),
        F.col("n_nationkey") == F.col("c_nationkey"),
        F.col("c_mktsegment") == "BUILDING",
    )
    return joined.select("n_nationkey", "n_name", "c_custkey")


@query("SELECT p_partkey, p_name FROM part LEFT JOIN lineitem ON p_partkey = l_partkey")
def left_join_multiplicity(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return joins.repeat_per_match(part, read_table(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, event_type FROM events ORDER BY ts, event_id")
def sorted_export(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").orderBy(*row_order(["ts", "event_id"]))
    return events.select("event_id", C.time_text(F.col("ts")).alias("event_time"), "event_type")


@query(
    """
    SELECT s_suppkey || '|' || s_name || '|' || coalesce(n_name, '') AS line
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1
    """
)
def delimited_line(spark, sf_dir):
    rows = joins.left_join_active(
        read_table(spark, sf_dir, "supplier"),
        read_table(spark, sf_dir, "nation"),
        F.col("s_nationkey") == F.col("n_nationkey"),
        F.col("n_regionkey") == 1,
    )
    line = C.delimited_line([F.col(c) for c in ("s_suppkey", "s_name", "n_name")], "|")
    path = fresh_dir(spark, "delimited")
    write_ordered(rows, line, ("s_suppkey",), path, compression="gzip")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    """
    SELECT 'orders' AS feed, CAST(max(o_orderkey) AS BIGINT) AS top_key FROM orders
    UNION ALL SELECT 'lineitem', CAST(max(l_orderkey) AS BIGINT) FROM lineitem
    """
)
def max_key(spark, sf_dir):
    found = [(t, keys.max_key(read_table(spark, sf_dir, t), k)) for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return spark.createDataFrame(found, "feed string, top_key long")


@query(f"SELECT count(*) AS row_count FROM ({ORDERS_SQL})")
def query_row_count(spark, sf_dir):
    register_tables(spark, sf_dir, "orders", "customer", "nation")
    top = keys.max_key(spark.table("orders"), "o_orderkey")
    return keys.row_count(feed_rows(spark, ORDERS_FEED, 0, top))


def plain_feed(table: str, key: str, order: str, condition: str = "true", **settings) -> FeedSpec:
    """A keyed feed of one table's key and order columns."""
    return FeedSpec(
        name=table,
        table=table,
        key=key,
        sql=f"SELECT {order}, {key} FROM {table} WHERE {key} > :start_pkid AND {key} <= :end_pkid AND {condition}",
        order_by=(order, key),
        **settings,
    )


@query(
    """
    SELECT 'orders' AS feed, CAST(max(o_orderkey) AS BIGINT) AS end_key FROM orders
    UNION ALL SELECT 'events', CAST(max(event_id) AS BIGINT) FROM events
    UNION ALL SELECT 'customer', CAST(max(c_custkey) AS BIGINT) FROM customer
    UNION ALL SELECT 'no_events', CAST(NULL AS BIGINT)
    """
)
def seed_high_water(spark, sf_dir):
    register_tables(spark, sf_dir, "orders", "events", "customer")
    spark.table("events").where("value < 0").createOrReplaceTempView("no_events")
    feeds = [
        plain_feed("orders", "o_orderkey", "o_orderdate"),
        plain_feed("events", "event_id", "ts", enabled=False),
        plain_feed("customer", "c_custkey", "c_name"),
        plain_feed("no_events", "event_id", "ts"),
    ]
    ledger = new_ledger(spark)
    seed(spark, feeds, ledger)
    return ledger.done().select("feed", "end_key")


@query(
    """
    SELECT 'orders' AS feed, (SELECT min(o_orderkey) FROM orders) AS start_key,
           (SELECT max(o_orderkey) FROM orders) AS end_key, count(*) AS rows
    FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders)
    UNION ALL
    SELECT 'customer', NULL, NULL, count(*) FROM customer
    WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
    """
)
def feed_catalogue(spark, sf_dir):
    register_tables(spark, sf_dir, "orders", "customer", "nation", "events")
    ledger = new_ledger(spark)
    first = spark.table("orders").agg(F.min("o_orderkey")).first()[0]
    ledger.close("orders", None, first, 0, None)
    feeds = [ORDERS_FEED, CUSTOMER_FEED, plain_feed("events", "event_id", "ts", enabled=False)]
    run_catalogue(spark, feeds, export_run(spark), ledger)
    return ledger.done().where("path IS NOT NULL").select("feed", "start_key", "end_key", "rows")


@query(f"SELECT line, CAST(1 AS BIGINT) AS deliveries FROM ({ORDERS_SQL})")
def replay_idempotent(spark, sf_dir):
    """Crash after the write: the range is exported again and found once."""
    register_tables(spark, sf_dir, "orders", "customer", "nation")
    ledger = new_ledger(spark)
    ledger.close("orders", None, 0, 0, None)
    run = export_run(spark)
    top = keys.max_key(spark.table("orders"), "o_orderkey")
    ledger.open_range("orders", 0, top)
    rows = feed_rows(spark, ORDERS_FEED, 0, top)
    lost = f"{run.out_dir}/feed=orders/start=0/end={top}"
    write_ordered(rows, feed_line(ORDERS_FEED, rows, run), ORDERS_FEED.order_by, lost)
    for _ in range(2):
        export_incremental(spark, ORDERS_FEED, run, ledger)
    deliveries = ledger.done().where("path IS NOT NULL").count()
    lines = read_delivered(spark, "orders", ledger).select("line")
    return lines.withColumn("deliveries", F.lit(deliveries).cast("long"))


@query(
    """
    SELECT 'orders' AS feed, CAST(0 AS BIGINT) AS start_key, max(o_orderkey) AS end_key,
           count(*) FILTER (WHERE o_totalprice < 0) AS rows, true AS no_file
    FROM orders
    """
)
def empty_range(spark, sf_dir):
    register_tables(spark, sf_dir, "orders")
    ledger = new_ledger(spark)
    ledger.close("orders", None, 0, 0, None)
    feed = plain_feed("orders", "o_orderkey", "o_orderdate", condition="o_totalprice < 0")
    export_incremental(spark, feed, export_run(spark), ledger)
    return ledger.done().where("start_key IS NOT NULL").select(
        "feed", "start_key", "end_key", "rows", F.col("path").isNull().alias("no_file")
    )


@query(
    """
    SELECT c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || CAST(CAST(c_acctbal AS DECIMAL(18,6)) AS VARCHAR)
           || ',' || coalesce(n_name, '') AS line
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2
    WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
    """
)
def full_only_catalogue(spark, sf_dir):
    """A catalogue without keyed feeds: its first run is recorded, its second delivers."""
    register_tables(spark, sf_dir, "customer", "nation")
    ledger, run = new_ledger(spark), export_run(spark)
    for _ in range(2):
        run_catalogue(spark, [CUSTOMER_FEED], run, ledger)
    return read_delivered(spark, "customer", ledger).select("line")


@query("SELECT o_orderkey || '' AS line FROM orders")
def empty_then_filled(spark, sf_dir):
    """A table that is empty at the first run: all that it has at the second is delivered."""
    orders = read_table(spark, sf_dir, "orders")
    feed = plain_feed("filling_orders", "o_orderkey", "o_orderdate", columns=("o_orderkey",), chunk_rows=5000)
    ledger, run = new_ledger(spark), export_run(spark)
    for table in (orders.where("o_orderkey IS NULL"), orders):
        table.createOrReplaceTempView("filling_orders")
        run_catalogue(spark, [feed], run, ledger)
    return read_delivered(spark, feed.name, ledger).select("line")


@query("SELECT 'orders' AS feed, max(o_orderkey) AS end_key, true AS due_at_first, false AS due_after_idle FROM orders")
def idle_interval(spark, sf_dir):
    """A run that finds nothing new counts for the interval as well."""
    register_tables(spark, sf_dir, "orders")
    ledger, run = new_ledger(spark), export_run(spark)
    feed = plain_feed("orders", "o_orderkey", "o_orderdate")
    due = is_due(ledger, datetime.now(timezone.utc), 3600)
    run_catalogue(spark, [feed], run, ledger)
    run_catalogue(spark, [feed], run, ledger)
    after = is_due(ledger, datetime.now(timezone.utc), 3600)
    marks = ledger.done().groupBy("feed").agg(F.max("end_key").alias("end_key"))
    return marks.select("feed", "end_key", F.lit(due).alias("due_at_first"), F.lit(after).alias("due_after_idle"))
