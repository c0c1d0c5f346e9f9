"""Late keys and table copies."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.functions.columns import time_text
from feedmill.operators.keys import key_range, max_key
from feedmill.plans.export import audit_late_keys, export_incremental
from feedmill.plans.sync import read_full, read_synced, sync_full, sync_incremental, write_version
from feedmill.registry.base import query
from feedmill.registry.exports import export_run, new_ledger, plain_feed
from feedmill.session import fresh_dir
from feedmill.sources.relational import key_edges, range_predicates, read_table


@query(
    """
    SELECT o_orderkey FROM orders
    WHERE o_orderstatus = 'P' AND o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'P')
      AND o_orderkey > 0
    """
)
def late_key_audit(spark, sf_dir):
    """Pending orders become visible only after the rest was exported."""
    orders = read_table(spark, sf_dir, "orders")
    orders.where("o_orderstatus <> 'P'").createOrReplaceTempView("arriving_orders")
    feed = plain_feed("arriving_orders", "o_orderkey", "o_orderdate", chunk_rows=5000)
    ledger, run = new_ledger(spark), export_run(spark, keep_keys=True)
    ledger.close(feed.name, None, 0, 0, None)
    export_incremental(spark, feed, run, ledger)
    orders.createOrReplaceTempView("arriving_orders")
    return audit_late_keys(spark, feed, run, ledger)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey > 0 AND o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def late_key_race(spark, sf_dir):
    """Open orders are committed after the keys were kept and before the export reads: it carries them, so they are not late.
    Pending ones come after it and are late. A second audit, once the late ones were exported as well, would open nothing."""
    orders = read_table(spark, sf_dir, "orders")
    orders.where("o_orderstatus = 'F'").createOrReplaceTempView("racing_orders")
    orders.where("o_orderstatus <> 'P'").createOrReplaceTempView("racing_orders_read")
    feed = plain_feed("racing_orders", "o_orderkey", "o_orderdate", chunk_rows=5000)
    feed = replace(feed, sql=feed.sql.replace("FROM racing_orders", "FROM racing_orders_read"))
    ledger, run = new_ledger(spark), export_run(spark, keep_keys=True)
    ledger.close(feed.name, None, 0, 0, None)
    export_incremental(spark, feed, run, ledger)
    orders.createOrReplaceTempView("racing_orders")
    return audit_late_keys(spark, feed, run, ledger)


@query("SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders")
def table_sync_incremental(spark, sf_dir):
    """The table arrives in two halves; a third run finds nothing new."""
    orders = read_table(spark, sf_dir, "orders")
    ledger, target = new_ledger(spark), fresh_dir(spark, "synced")
    half = max_key(orders, "o_orderkey") // 2
    for source in (orders.where(key_range(orders.o_orderkey, None, half)), orders, orders):
        sync_incremental(source, "orders", "o_orderkey", target, ledger)
    copied = read_synced(spark, "orders", target, ledger)
    return copied.withColumn("o_orderdate", time_text(F.col("o_orderdate")))


@query("SELECT *, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS rows_meanwhile FROM customer")
def table_sync_full(spark, sf_dir):
    """A run that is lost between write and commit leaves the earlier version in place; the next one replaces it."""
    customers, target, ledger = read_table(spark, sf_dir, "customer"), fresh_dir(spark, "copied"), new_ledger(spark)
    sync_full(customers.where("c_mktsegment = 'BUILDING'"), "customer", target, ledger)
    write_version(customers, target)
    meanwhile = read_full(spark, "customer", ledger).count()
    sync_full(customers, "customer", target, ledger)
    return read_full(spark, "customer", ledger).withColumn("rows_meanwhile", F.lit(meanwhile).cast("long"))


@query("SELECT 8 AS ranges, count(*) AS rows, count(DISTINCT o_orderkey) AS found, true AS even FROM orders")
def equal_height_ranges(spark, sf_dir):
    """A table whose keys lie ever further apart, read by the conditions of equal-height ranges: all rows once, evenly.

    The cubes are decimals of 38 digits, as a long holds those of keys up to two million only."""
    wide = F.col("o_orderkey").cast("decimal(38,0)")
    sparse = read_table(spark, sf_dir, "orders").select("o_orderkey", (wide * wide * wide).alias("pk"))
    predicates = range_predicates("pk", key_edges(sparse, "pk", 8))
    read = reduce(DataFrame.union, [sparse.where(p).withColumn("range", F.lit(i)) for i, p in enumerate(predicates)])
    sizes = read.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("found"))
    even = F.max("n") * 8 <= F.sum("n") * 1.1 + 8
    return sizes.agg(F.count(F.lit(1)).cast("int").alias("ranges"), F.sum("n").alias("rows"), F.sum("found").alias("found"), even.alias("even"))
