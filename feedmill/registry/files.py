"""Line files written from the events table, read back as a batch and as a stream."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedmill.operators import checks
from feedmill.operators.layouts import NARROW_INPUT, WIDE_INPUT, narrow_layout, wide_layout
from feedmill.plans.convert import PART_ROWS, LineFeed, read_rejects, run_line_feeds
from feedmill.registry.base import query
from feedmill.registry.lines import EVENT_LINES_SQL, JUDGED_SQL, WIDE_SQL, event_lines
from feedmill.session import fresh_dir, list_paths, move_paths
from feedmill.sinks.ledger import MoveLog, SeenFiles
from feedmill.sources.line_files import list_files, read_lines, read_unseen
from feedmill.sources.relational import read_table
from feedmill.streaming.convert import convert_stream, convert_stream_parts, stream_lines
from feedmill.streaming.poll import poll_feeds

CUTOFF = "2024-01-16 00:00:00"
# Spark names its files part-..., so that is the prefix of the feed.
PREFIX = "PART-"


def drop_lines(lines, folder: str) -> None:
    """Add line files with a .log ending to the folder, byte for byte; they are written aside and appear complete."""
    spark, aside = lines.sparkSession, fresh_dir(lines.sparkSession, "written")
    lines.write.text(aside)
    move_paths(spark, [(path, f"{folder}/{path.rpartition('/')[2].replace('.txt', '.log')}") for path in list_paths(spark, aside)])


def _lines(spark, sf_dir, condition="true"):
    """Event lines; some end in a carriage return, which stays."""
    return event_lines(read_table(spark, sf_dir, "events").where(condition)).select("line")


@query(f"SELECT line FROM ({EVENT_LINES_SQL})")
def file_feed_scan(spark, sf_dir):
    """Other files in the folder are left alone."""
    folder = fresh_dir(spark, "drop")
    drop_lines(_lines(spark, sf_dir), folder)
    read_table(spark, sf_dir, "customer").select("c_name").write.mode("append").text(folder)
    return read_lines(spark, folder, PREFIX).select("line")


@query(f"SELECT line FROM ({EVENT_LINES_SQL}) WHERE ts >= TIMESTAMP '{CUTOFF}'")
def file_feed_dedup(spark, sf_dir):
    folder = fresh_dir(spark, "drop")
    seen = SeenFiles(spark, fresh_dir(spark, "seen"))
    drop_lines(_lines(spark, sf_dir, f"ts < '{CUTOFF}'"), folder)
    seen.add("events", list_files(spark, folder, PREFIX))
    drop_lines(_lines(spark, sf_dir, f"ts >= '{CUTOFF}'"), folder)
    lines, files = read_unseen(spark, folder, PREFIX, seen.names("events"))
    seen.add("events", files)
    assert read_unseen(spark, folder, PREFIX, seen.names("events")) is None
    return lines.select("line")


@query(
    f"""
    SELECT 'ok' AS reason, out AS line FROM ({WIDE_SQL})
    UNION ALL SELECT reason, line FROM ({JUDGED_SQL}) WHERE reason IS NOT NULL
    """
)
def stream_file_feed(spark, sf_dir):
    """New files between two runs of the stream are converted once, earlier ones not again."""
    folder, out, checkpoint = (fresh_dir(spark, d) for d in ("drop", "converted", "checkpoint"))
    for condition in (f"ts < '{CUTOFF}'", f"ts >= '{CUTOFF}'"):
        drop_lines(_lines(spark, sf_dir, condition), folder)
        convert_stream(
            stream_lines(spark, folder, PREFIX), WIDE_INPUT, wide_layout, out, checkpoint, once=True
        ).awaitTermination()
    return spark.read.option("lineSep", "\n").text(out).select("reason", F.col("value").alias("line"))


@query(f"SELECT out AS line, true AS fits FROM ({WIDE_SQL})")
def stream_file_parts(spark, sf_dir):
    """As above, into files of a fixed number of lines."""
    folder, out, bad, checkpoint = (fresh_dir(spark, d) for d in ("drop", "parts", "rejects", "checkpoint"))
    drop_lines(_lines(spark, sf_dir), folder)
    convert_stream_parts(
        stream_lines(spark, folder, PREFIX), WIDE_INPUT, wide_layout, out, bad, checkpoint, once=True
    ).awaitTermination()
    lines = spark.read.text(f"{out}/batch=*").select("file_name", F.col("value").alias("line"))
    sizes = lines.groupBy("file_name").agg((F.count(F.lit(1)) <= PART_ROWS).alias("fits"))
    return lines.join(sizes, "file_name").select("line", "fits")


@query(f"SELECT out AS line, CAST(NULL AS VARCHAR) AS reason FROM ({WIDE_SQL}) UNION ALL SELECT line, reason FROM ({JUDGED_SQL}) WHERE reason IS NOT NULL")
def convert_line_feeds(spark, sf_dir):
    """Two passes over a folder that grows in between, and a feed that is switched off."""
    folder, out, bad = (fresh_dir(spark, d) for d in ("drop", "batches", "rejects"))
    seen = SeenFiles(spark, fresh_dir(spark, "seen"))
    feeds = [
        LineFeed("events", folder, PREFIX, WIDE_INPUT, wide_layout),
        LineFeed("off", folder, PREFIX, WIDE_INPUT, wide_layout, enabled=False),
    ]
    for condition in (f"ts < '{CUTOFF}'", f"ts >= '{CUTOFF}'"):
        drop_lines(_lines(spark, sf_dir, condition), folder)
        run_line_feeds(spark, feeds, out, bad, seen)
    good = spark.read.text(out).select(F.col("value").alias("line"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(read_rejects(spark, bad).select("line", "reason"))


@query("SELECT '*.log' AS pattern, count(*) > 0 AS ok FROM events UNION ALL SELECT '*.dat', false")
def file_freshness(spark, sf_dir):
    """Files written just now into today's folder are fresh; none of the other pattern is there."""
    root, today = fresh_dir(spark, "daily"), datetime.now(timezone.utc)
    drop_lines(_lines(spark, sf_dir), f"{root}/{today:%Y%m%d}")

    def check(pattern):
        found = checks.file_freshness(spark, root, "%Y%m%d", pattern, today.replace(tzinfo=None), 5)
        return found.select(F.lit(pattern).alias("pattern"), "ok")

    return check("*.log").unionByName(check("*.dat"))


@query(f"SELECT CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'archived' ELSE 'waiting' END AS place, line FROM ({EVENT_LINES_SQL})")
def archived_files(spark, sf_dir):
    """Files converted by a batch leave their folder; those that come later wait there for the next one."""
    folder, archive, out, bad = (fresh_dir(spark, d) for d in ("drop", "archive", "batches", "rejects"))
    seen, moves = SeenFiles(spark, fresh_dir(spark, "seen")), MoveLog(spark, fresh_dir(spark, "moves"))
    feed = LineFeed("events", folder, PREFIX, WIDE_INPUT, wide_layout, archive=archive)
    drop_lines(_lines(spark, sf_dir, f"ts < '{CUTOFF}'"), folder)
    run_line_feeds(spark, [feed], out, bad, seen, moves)
    drop_lines(_lines(spark, sf_dir, f"ts >= '{CUTOFF}'"), folder)
    run_line_feeds(spark, [replace(feed, enabled=False)], out, bad, seen, moves)
    places = [read_lines(spark, path, PREFIX).select(F.lit(place).alias("place"), "line") for path, place in ((archive, "archived"), (folder, "waiting"))]
    return places[0].unionByName(places[1])


SUPPLIER_CODES_SQL = """
    SELECT *, CASE WHEN s_acctbal >= 0 THEN 'DÉ-' || s_suppkey WHEN s_suppkey % 2 = 0 THEN repeat('é', 50) ELSE repeat('é', 51) END AS code
    FROM supplier
"""


@query(
    f"""
    SELECT feed, reason, replace(replace(hex(encode(line)), 'C3A9', 'E9'), 'C389', 'C9') AS line FROM (
        SELECT 'plain' AS feed, CASE WHEN length(code) > 50 THEN 'long_code' ELSE 'ok' END AS reason,
               CASE WHEN length(code) > 50 THEN 'x,x,' || s_suppkey || ',' || code || repeat(',', 16)
                    ELSE '0008' || chr(9) || '8' || chr(9) || chr(9) || code || chr(9) || '01' END AS line
        FROM ({SUPPLIER_CODES_SQL})
        UNION ALL SELECT 'validated', 'bad_encoding', 'x,x,' || s_suppkey || ',' || code || repeat(',', 16) FROM ({SUPPLIER_CODES_SQL}))
    """
)
def encoded_feed(spark, sf_dir):
    """Lines in Latin-1: lengths are judged in their bytes and the output has them; a feed that asks for UTF-8 rejects all."""
    code = (
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("DÉ-"), F.col("s_suppkey").cast("string")))
        .when(F.col("s_suppkey") % 2 == 0, F.repeat(F.lit("é"), 50))
        .otherwise(F.repeat(F.lit("é"), 51))
    )
    line = F.concat(F.lit("x,x,"), F.col("s_suppkey").cast("string"), F.lit(","), code, F.repeat(F.lit(","), 16))
    folder = fresh_dir(spark, "drop")
    drop_lines(read_table(spark, sf_dir, "supplier").select(F.encode(line, "ISO-8859-1").cast("string")), folder)
    latin = replace(NARROW_INPUT, encoding="latin-1")
    found = []
    for name, fmt in (("plain", latin), ("validated", replace(NARROW_INPUT, validated=True))):
        out, bad = fresh_dir(spark, "batches"), fresh_dir(spark, "rejects")
        feed = LineFeed(name, folder, PREFIX, fmt, narrow_layout)
        run_line_feeds(spark, [feed], out, bad, SeenFiles(spark, fresh_dir(spark, "seen")))
        if name == "plain":
            found.append(spark.read.text(out).select(F.lit(name).alias("feed"), F.lit("ok").alias("reason"), F.col("value").alias("line")))
        found.append(read_rejects(spark, bad).select(F.lit(name).alias("feed"), "reason", "line"))
    lines = found[0].unionByName(found[1]).unionByName(found[2])
    return lines.withColumn("line", F.hex(F.col("line").cast("binary")))


@query(
    f"""
    SELECT out AS line FROM ({WIDE_SQL}) WHERE ts < TIMESTAMP '{CUTOFF}'
    UNION ALL SELECT out FROM ({WIDE_SQL}) WHERE ts >= TIMESTAMP '{CUTOFF}'
    """
)
def polled_feed(spark, sf_dir):
    """Three polls: files, nothing new but the old names with other lines, and new files. Each name is converted once, though its
    file had left the folder for the archive before the name came again."""
    folder, archive, out, bad = (fresh_dir(spark, d) for d in ("drop", "archive", "polled", "rejects"))
    seen, moves = SeenFiles(spark, fresh_dir(spark, "seen")), MoveLog(spark, fresh_dir(spark, "moves"))
    feed = LineFeed("events", folder, PREFIX, WIDE_INPUT, wide_layout, archive=archive)
    polls = poll_feeds(spark, [feed], out, bad, seen, moves, period=0, rounds=3)
    drop_lines(_lines(spark, sf_dir, f"ts < '{CUTOFF}'"), folder)
    next(polls)
    again = fresh_dir(spark, "again")
    _lines(spark, sf_dir, f"ts >= '{CUTOFF}'").coalesce(1).write.text(again)
    (lines,), old = list_paths(spark, again), list_paths(spark, archive)
    move_paths(spark, [(lines, f"{folder}/{old[0].rpartition('/')[2]}")])
    assert next(polls) == []
    drop_lines(_lines(spark, sf_dir, f"ts >= '{CUTOFF}'"), folder)
    next(polls)
    return spark.read.text(out).select(F.col("value").alias("line"))
