"""Numbering rows and cutting results into files."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.operators import joins
from feedmill.operators.chunks import chunk_column, manifest, number_rows, part_column
from feedmill.plans.convert import PART_ROWS
from feedmill.plans.export import delivered_manifest, export_full, read_delivered, run_catalogue
from feedmill.registry.base import query
from feedmill.registry.exports import CUSTOMER_FEED, ORDERS_FEED, ORDERS_SQL, export_run, new_ledger
from feedmill.session import fresh_dir
from feedmill.sinks.delivery import check_files, read_files
from feedmill.sources.relational import read_table, register_tables
from feedmill.spec import FeedSpec


def numbered_sql(columns: str, source: str, order: str, chunk_rows: int = PART_ROWS) -> str:
    return f"""
        SELECT {columns}, rn,
               CASE WHEN total <= {chunk_rows} THEN 0 ELSE (rn - 1) // {chunk_rows} + 1 END AS chunk
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS total FROM {source})
    """


def chunked(df, order_by, chunk_rows=PART_ROWS, written=True):
    return number_rows(df, order_by, written=written).rows.withColumn("chunk", chunk_column(chunk_rows))


@query(numbered_sql("event_id", "events", "ts, event_id"))
def chunk_assignment(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return chunked(events, ("ts", "event_id")).select("event_id", "rn", "chunk")


@query(
    numbered_sql(
        "l_orderkey, l_linenumber, l_partkey, l_suppkey",
        "lineitem",
        "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey",
    )
)
def chunk_assignment_ties(spark, sf_dir):
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = read_table(spark, sf_dir, "lineitem").select("l_shipdate", *key)
    return chunked(lines, ("l_shipdate", *key)).select(*key, "rn", "chunk")


@query(
    numbered_sql(
        "o_orderkey",
        "(SELECT o_orderkey, c_name FROM orders LEFT JOIN customer"
        " ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING')",
        "c_name NULLS LAST, o_orderkey",
    )
)
def chunk_assignment_nulls(spark, sf_dir):
    """Most sort values are NULL, which come last."""
    joined = joins.left_join_active(
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "customer"),
        F.col("o_custkey") == F.col("c_custkey"),
        F.col("c_mktsegment") == "BUILDING",
    ).select("o_orderkey", "c_name")
    return chunked(joined, ("c_name", "o_orderkey"), written=False).select("o_orderkey", "rn", "chunk")


@query(
    f"""
    SELECT event_type, event_id, rn, (rn - 1) // {PART_ROWS} + 1 AS chunk
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
    """
)
def chunk_per_file(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    numbered = number_rows(events, ("ts", "event_id"), ("event_type",), written=True).rows
    return numbered.select("event_type", "event_id", "rn", part_column(PART_ROWS).alias("chunk"))


@query(
    f"""
    SELECT chunk, count(*) AS rows, min(event_id) AS min_key, max(event_id) AS max_key
    FROM ({numbered_sql("event_id", "events", "ts, event_id", 2000)}) GROUP BY chunk
    """
)
def chunk_manifest(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return manifest(chunked(events, ("ts", "event_id"), 2000), "event_id")


def _named_chunks(name: str, source: str, order: str, chunk_rows: int) -> str:
    """File names and positions of the ordered lines of ``source``, which also has a ``key``."""
    return f"""
        SELECT CASE WHEN total <= {chunk_rows} THEN '{name}.dat'
                    ELSE '{name}_' || lpad(CAST((rn - 1) // {chunk_rows} + 1 AS VARCHAR), 4, '0') || '.dat' END AS file_name,
               CASE WHEN total <= {chunk_rows} THEN rn ELSE (rn - 1) % {chunk_rows} + 1 END AS position, line, key
        FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS total FROM {source})
    """


ORDER_FILES_SQL = _named_chunks("ORDERS-20240201063000", f"(SELECT *, o_orderkey AS key FROM ({ORDERS_SQL}))", "o_orderdate, o_orderkey", 5000)
CUSTOMER_LINES_SQL = """
    SELECT c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || CAST(c_acctbal AS DECIMAL(18,6)) || ','
           || coalesce(n_name, '') AS line, c_name, c_custkey, NULL::BIGINT AS key
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2
    WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
"""
CUSTOMER_FILES_SQL = _named_chunks("CUSTOMER-20240201063000", f"({CUSTOMER_LINES_SQL})", "c_name, c_custkey", 2000)


def _deliver_both(spark, sf_dir, **settings):
    """Run the two feeds; the ledger that knows what was delivered."""
    register_tables(spark, sf_dir, "orders", "customer", "nation")
    ledger = new_ledger(spark)
    ledger.close("orders", None, 0, 0, None)
    run = export_run(spark, **settings)
    run_catalogue(spark, [ORDERS_FEED, CUSTOMER_FEED], run, ledger)
    return run, ledger


@query(f"SELECT file_name, position, line FROM ({ORDER_FILES_SQL} UNION ALL {CUSTOMER_FILES_SQL})")
def chunk_files(spark, sf_dir):
    """Two feeds delivered as files, read back in their order."""
    _, ledger = _deliver_both(spark, sf_dir)
    lines = read_delivered(spark, "orders", ledger).unionByName(read_delivered(spark, "customer", ledger))
    return lines.select("file_name", "position", "line")


@query(
    f"""
    SELECT file_name, count(*) AS rows, min(key) AS min_key, max(key) AS max_key,
           CAST(sum(octet_length(CAST(line AS BLOB)) + 1) AS BIGINT) AS bytes, count(*) AS lines, true AS ok
    FROM ({ORDER_FILES_SQL} UNION ALL {CUSTOMER_FILES_SQL}) GROUP BY file_name
    """
)
def delivery_manifest(spark, sf_dir):
    """What the manifests tell of the files, and whether the files found are as told."""
    _, ledger = _deliver_both(spark, sf_dir)
    told = delivered_manifest(spark, "orders", ledger).unionByName(delivered_manifest(spark, "customer", ledger))
    paths = ledger.paths("orders") + ledger.paths("customer")
    checked = check_files(spark, paths).select("file_name", "ok")
    return told.join(checked, "file_name", "left").select("file_name", "rows", "min_key", "max_key", "bytes", "lines", "ok")


@query(f"SELECT file_name, position, line FROM ({ORDER_FILES_SQL})")
def backup_copy(spark, sf_dir):
    """The backup of a run, in a folder of its day, read by its own manifest."""
    run, ledger = _deliver_both(spark, sf_dir, backup_dir=fresh_dir(spark, "backup"))
    kept = [f"{run.backup_dir}/20240201/feed=orders/start=0/end={ledger.mark('orders')}"]
    return read_files(spark, kept).select("file_name", "position", "line")


@query(
    """
    SELECT 'EVENTS-20240201063000.dat' AS file_name, row_number() OVER (ORDER BY ts, event_id) AS position,
           event_id || ',' || event_type AS line
    FROM events
    """
)
def unsplit_name(spark, sf_dir):
    """A feed without a row limit is one file under its stamped name, however many parts hold it."""
    register_tables(spark, sf_dir, "events")
    feed = FeedSpec(
        name="all_events", sql="SELECT event_id, event_type, ts FROM events", order_by=("ts", "event_id"),
        columns=("event_id", "event_type"), chunk_rows=0, file_name="EVENTS-[DT].dat",
    )
    ledger = new_ledger(spark)
    export_full(spark, feed, export_run(spark), ledger)
    return read_delivered(spark, feed.name, ledger).select("file_name", "position", "line")
