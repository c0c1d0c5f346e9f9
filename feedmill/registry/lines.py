"""Line validation and fixed layouts, over lines made from the events and supplier tables.

The lines carry faults that depend on type and value of the event, so every rule finds some.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill.functions import columns as C
from feedmill.operators import joins
from feedmill.operators.layouts import NARROW_INPUT, WIDE_INPUT, narrow_layout, wide_layout
from feedmill.operators.validate import accepted, field_count, judge_lines, rejects
from feedmill.registry.base import query
from feedmill.sources.relational import read_table

LISTED = "DEV-1:DEV-20:DEV-77:DEV-100:DEV-149"


def event_lines(events):
    """One line of 17 fields per event, some faulty."""
    kind, value, ts = F.col("event_type"), F.col("value"), F.col("ts")
    price = value.cast("decimal(10,2)").cast("string")
    micros = F.date_format(ts, "SSSSSS")
    user = F.col("user_id").cast("string")
    event = F.col("event_id").cast("string")
    empty = F.lit("")
    record_time = (
        F.when((kind == "error") & (value < 2), empty)
        .when((kind == "error") & (value < 5), F.lit("yesterday"))
        .when(kind == "view", F.date_format(ts, "yyyy-M-d H:m:s"))
        .otherwise(C.time_text(ts))
    )
    id_a = F.when((kind == "click") & (value < 2), empty).otherwise(F.concat(F.lit("A-"), user))
    id_b = F.when(kind == "signup", empty).otherwise(F.concat(F.lit("B-"), event))
    longitude = (
        F.when((kind == "purchase") & (value < 1), F.lit("n/a"))
        .when(kind == "purchase", empty)
        .otherwise(F.concat(price, F.substring(micros, 1, 5)))
    )
    latitude = F.concat(F.lit("-"), price, F.substring(micros, 2, 5))
    code = (
        F.when((kind == "click") & (value < 4), empty)
        .when((kind == "click") & (value > 150), F.repeat(F.lit("D"), 51))
        .otherwise(F.concat(F.lit("DEV-"), user))
    )
    id_c = F.when(kind.isin("view", "error"), empty).otherwise(F.concat(F.lit("C-"), event))
    head = F.concat_ws(
        ",", F.lit("i"), kind, empty, id_a, id_b, longitude, latitude, record_time,
        F.lit("1"), F.lit("d"), F.lit("-70"), empty, empty, code, F.lit("v"), empty,
    )
    tail = (
        F.when((kind == "signup") & (value < 3), F.concat(F.lit(","), id_c, F.lit(",extra")))
        .when((kind == "signup") & (value < 5), empty)
        .when(kind == "view", F.concat(F.lit(","), id_c, F.lit("\r")))
        .otherwise(F.concat(F.lit(","), id_c))
    )
    return events.select(
        "event_id", "ts", "event_type", "user_id", F.lit("events").alias("file_name"), F.concat(head, tail).alias("line")
    )


EVENT_LINES_SQL = """
    SELECT event_id, ts, event_type, user_id,
      'i,' || event_type || ',,'
      || CASE WHEN event_type = 'click' AND value < 2 THEN '' ELSE 'A-' || user_id END || ','
      || CASE WHEN event_type = 'signup' THEN '' ELSE 'B-' || event_id END || ','
      || CASE WHEN event_type = 'purchase' AND value < 1 THEN 'n/a' WHEN event_type = 'purchase' THEN ''
              ELSE CAST(value AS DECIMAL(10,2)) || substr(strftime(ts, '%f'), 1, 5) END || ','
      || '-' || CAST(value AS DECIMAL(10,2)) || substr(strftime(ts, '%f'), 2, 5) || ','
      || CASE WHEN event_type = 'error' AND value < 2 THEN '' WHEN event_type = 'error' AND value < 5 THEN 'yesterday'
              WHEN event_type = 'view' THEN strftime(ts, '%Y-%-m-%-d %-H:%-M:%-S')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
      || ',1,d,-70,,,'
      || CASE WHEN event_type = 'click' AND value < 4 THEN '' WHEN event_type = 'click' AND value > 150 THEN repeat('D', 51)
              ELSE 'DEV-' || user_id END
      || ',v,'
      || CASE WHEN event_type = 'signup' AND value < 3 THEN ',C-' || event_id || ',extra'
              WHEN event_type = 'signup' AND value < 5 THEN ''
              WHEN event_type = 'view' THEN ',' || chr(13)
              WHEN event_type = 'error' THEN ','
              ELSE ',C-' || event_id END AS line
    FROM events
"""

JUDGED_SQL = f"""
    SELECT event_id, ts, event_type, user_id, line, f,
      CASE WHEN len(f) <> 17 THEN 'arity'
           WHEN f[8] = '' THEN 'no_time'
           WHEN try_strptime(f[8], '%Y-%m-%d %H:%M:%S') IS NULL THEN 'bad_time'
           WHEN f[4] = '' THEN 'no_id'
           WHEN f[14] = '' THEN 'no_code'
           WHEN octet_length(CAST(f[14] AS BLOB)) > 50 THEN 'long_code'
           WHEN f[6] <> '' AND try_cast(f[6] AS DOUBLE) IS NULL THEN 'bad_longitude'
           WHEN f[7] <> '' AND try_cast(f[7] AS DOUBLE) IS NULL THEN 'bad_latitude' END AS reason
    FROM (SELECT *, string_split(trim(line, chr(13)), ',') AS f FROM ({EVENT_LINES_SQL}))
"""

WIDE_SQL = f"""
    SELECT event_id, ts, event_type,
      CAST(epoch(strptime(f[8], '%Y-%m-%d %H:%M:%S')) AS BIGINT) || ',27,,,,,' || f[4] || ','
      || left(f[5], greatest(length(f[5]) - 1, 0)) || ',,,,' || f[14] || ','
      || CASE WHEN f[6] = '' THEN '' ELSE printf('%.6f', CAST(f[6] AS DOUBLE)) END || ','
      || CASE WHEN f[7] = '' THEN '' ELSE printf('%.6f', CAST(f[7] AS DOUBLE)) END || ',,,,,'
      || CASE WHEN f[17] = '' THEN '' ELSE f[17] || '0000' END || ',,' AS out
    FROM ({JUDGED_SQL}) WHERE reason IS NULL
"""


def judged_events(spark, sf_dir, codes=""):
    return judge_lines(event_lines(read_table(spark, sf_dir, "events")), WIDE_INPUT, codes)


@query(
    f"""
    WITH lines AS (
      SELECT 'event' AS kind, event_id AS id, line FROM ({EVENT_LINES_SQL})
      UNION ALL SELECT 'document', doc_id, unnest(string_split(text, chr(10))) FROM documents)
    SELECT kind, id, len(string_split(line, ',')) AS n_fields, len(string_split(line, ',')) = 17 AS fits, count(*) AS n_lines,
           CAST(sum(length(trim(line, chr(13)))) AS BIGINT) AS n_chars
    FROM lines GROUP BY ALL
    """
)
def line_arity(spark, sf_dir):
    events = event_lines(read_table(spark, sf_dir, "events")).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "line")
    documents = read_table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("line")
    )
    n_fields = field_count(F.col("line"))
    return (
        events.unionByName(documents)
        .select("kind", "id", n_fields.cast("long").alias("n_fields"), (n_fields == 17).alias("fits"), C.strip_line_end(F.col("line")).alias("line"))
        .groupBy("kind", "id", "n_fields", "fits")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))
    )


@query(f"SELECT event_id, reason, line FROM ({JUDGED_SQL}) WHERE reason IS NOT NULL")
def reject_reasons(spark, sf_dir):
    return judged_events(spark, sf_dir).where("reason IS NOT NULL").select("event_id", "reason", "line")


@query(f"SELECT reason, count(*) AS n_lines FROM ({JUDGED_SQL}) WHERE reason IS NOT NULL GROUP BY reason")
def reject_counts(spark, sf_dir):
    return rejects(judged_events(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    f"""
    SELECT event_id, f[14] AS device_code FROM ({JUDGED_SQL})
    WHERE reason IS NULL AND f[14] IN ('{"', '".join(LISTED.split(":"))}')
    """
)
def allow_list(spark, sf_dir):
    return accepted(judged_events(spark, sf_dir, LISTED)).select("event_id", "device_code")


@query(
    f"""
    SELECT event_id, f[14] AS device_code FROM ({JUDGED_SQL})
    WHERE reason IS NULL AND f[14] IN (SELECT 'DEV-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """
)
def allow_list_table(spark, sf_dir):
    codes = (
        read_table(spark, sf_dir, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.concat(F.lit("DEV-"), F.col("c_custkey").cast("string")))
    )
    listed = joins.only_listed(accepted(judged_events(spark, sf_dir)), "device_code", codes)
    return listed.select("event_id", "device_code")


@query(f"SELECT event_id, out FROM ({WIDE_SQL})")
def fixed_layout_wide(spark, sf_dir):
    return accepted(judged_events(spark, sf_dir)).transform(wide_layout).select("event_id", "out")


@query(
    """
    SELECT s_suppkey, '0008' || chr(9) || '8' || chr(9) || chr(9) || s_name || chr(9) || '01' AS out
    FROM supplier WHERE s_acctbal >= 0
    """
)
def fixed_layout_narrow(spark, sf_dir):
    """Suppliers in the red send lines that lack a field."""
    blank = [F.lit("x")] * 15
    line = F.concat_ws(
        ",", *blank[:3], F.col("s_name"), *blank, F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string"))
    )
    lines = read_table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))
    return accepted(judge_lines(lines, NARROW_INPUT)).transform(narrow_layout).select("s_suppkey", "out")
