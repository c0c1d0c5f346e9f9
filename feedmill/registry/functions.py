"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import columns as C
from feedmill.registry.base import query
from feedmill.sources.relational import read_table


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events")
def time_text(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", C.time_text(F.col("ts")).alias("ts_text"))


@query(
    """
    SELECT event_id,
           CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS padded,
           CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS unpadded,
           CAST(NULL AS BIGINT) AS broken
    FROM events
    """
)
def epoch_seconds(spark, sf_dir):
    ts = F.col("ts")
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        C.epoch_seconds(C.time_text(ts)).alias("padded"),
        C.epoch_seconds(F.date_format(ts, "yyyy-M-d  H:m:s")).alias("unpadded"),
        C.epoch_seconds(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).alias("broken"),
    )


@query(
    """
    WITH n AS (
      SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS plain,
             CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS fine
      FROM customer)
    SELECT c_custkey,
           CASE WHEN abs(CAST(plain AS DECIMAL(18,2))) < 1000
                THEN CAST(CAST(plain AS DECIMAL(9,6)) AS VARCHAR) END AS as_decimal,
           abs(CAST(plain AS DECIMAL(18,2))) >= 1000 AS too_wide,
           printf('%.6f', CAST(fine AS DOUBLE)) AS as_float,
           printf('%.6f', CAST(CAST(4000000000 + c_custkey % 7 AS VARCHAR) || '.0000005' AS DOUBLE)) AS as_large,
           CAST(9007199254740992 + 2 * c_custkey AS VARCHAR) || '.000000' AS as_whole, false AS prints_huge
    FROM n
    """
)
def fixed_six(spark, sf_dir):
    plain = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    # Seven decimals, so that every last digit, ties included, occurs.
    fine = F.concat(plain, F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.decimal_six(plain).alias("as_decimal"),
        C.decimal_six_bad(plain).alias("too_wide"),
        C.float_six(fine).alias("as_float"),
        C.float_six(F.concat((F.lit(4000000000) + F.col("c_custkey") % 7).cast("string"), F.lit(".0000005"))).alias("as_large"),
        C.float_six((F.lit(9007199254740992) + 2 * F.col("c_custkey")).cast("string")).alias("as_whole"),
        C.is_printable(F.concat(F.lit("1"), F.col("c_custkey").cast("string"), F.lit("e40"))).alias("prints_huge"),
    )


@query(
    """
    SELECT 'page' AS kind, page_id AS id,
           nullif(replace(regexp_replace('#' || url, '[^a-zA-Z0-9|#-]', '', 'g'), '#', '/'), '') AS kept FROM pages
    UNION ALL
    SELECT 'document', doc_id,
           nullif(replace(regexp_replace('#' || text, '[^a-zA-Z0-9|#-]', '', 'g'), '#', '/'), '') FROM documents
    """
)
def charset_whitelist(spark, sf_dir):
    def kept(table, kind, key, text):
        value = C.concat_text(F.lit("#"), F.col(text))
        return read_table(spark, sf_dir, table).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), C.whitelist(value).alias("kept")
        )

    return kept("pages", "page", "page_id", "url").unionByName(kept("documents", "document", "doc_id", "text"))


@query("SELECT doc_id, translate(replace(text, ',', ' '), chr(10) || chr(13), '  ') AS scrubbed FROM documents")
def delimiter_scrub(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", C.scrub(F.col("text")).alias("scrubbed"))


@query(
    """
    SELECT c_custkey, left(c_name, length(c_name) - 1) AS shortened, left('', 0) AS empty_shortened,
           CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name || '0000' END AS suffixed
    FROM customer
    """
)
def drop_last_add_suffix(spark, sf_dir):
    name = F.col("c_name")
    some = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(name)
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.drop_last(name).alias("shortened"),
        C.drop_last(F.lit("")).alias("empty_shortened"),
        C.add_suffix(some, "0000").alias("suffixed"),
    )
