"""Running feeds: seeding, incremental and full exports, and the whole catalogue."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.functions.columns import delimited_line, scrub
from feedmill.operators.chunks import number_rows
from feedmill.operators.keys import BLOCK_BITS, differing_blocks, key_block, key_digests, key_range, late_keys, max_key
from feedmill.session import fresh_dir
from feedmill.sinks.delimited import stamp_name
from feedmill.sinks.delivery import check_files, file_manifest, plan_files, read_files, read_manifest, write_files, write_manifest
from feedmill.sinks.ledger import KeyDigests, Ledger
from feedmill.spec import FeedSpec


LOWEST_KEY = -(2**63)


@dataclass(frozen=True)
class ExportRun:
    """Settings shared by the feeds of one run."""

    out_dir: str
    now: datetime
    chunk_rows: int = 2000
    delimiter: str = ","
    scrub_text: bool = False
    compression: str = "none"
    backup_dir: str | None = None
    by_day: bool = False
    keep_keys: bool = False
    interval_seconds: int = 0
    parallel: int = 1


def feed_rows(spark: SparkSession, feed: FeedSpec, start: int | None = None, end: int | None = None) -> DataFrame:
    """The feed's result, bounded by the key range when it is incremental; no start means from the beginning."""
    first = LOWEST_KEY if start is None else start
    bounds = {"start_pkid": first, "end_pkid": end} if feed.incremental else None
    return spark.sql(feed.sql, args=bounds)


def feed_line(feed: FeedSpec, df: DataFrame, run: ExportRun):
    """The rendered line of a feed row."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    names = feed.columns or tuple(df.columns)
    return delimited_line(
        [scrub(F.col(n), run.delimiter) if run.scrub_text and n in text else F.col(n) for n in names],
        run.delimiter,
    )


def highest_key(spark: SparkSession, feed: FeedSpec, above: int | None = None) -> int | None:
    """The highest key of the feed's table (above a mark), or None if there is none."""
    return feed.top_key(above) if feed.top_key else max_key(spark.table(feed.table), feed.key, above)


def seed(spark: SparkSession, feeds: list[FeedSpec], ledger: Ledger) -> None:
    """Start each keyed feed, also a disabled one, at its table's highest key; export nothing.

    The feed of an empty table is seeded without a mark: its next export starts from the beginning.
    """
    for feed in feeds:
        if feed.incremental:
            ledger.close(feed.name, None, highest_key(spark, feed), 0, None)


def deliver(
    feed: FeedSpec, df: DataFrame, run: ExportRun, sub_dir: str, day: str, keys_path: str | None = None
) -> tuple[int, str | None]:
    """Write a feed's rows under ``sub_dir``; no rows write nothing. Returns rows and path.

    With ``keys_path`` the delivered keys are written there, if the feed's result has its key.
    The feed's query runs once, into a staged copy: count, numbers, files, manifest and backup all come from that. A backup is
    read again and compared with the manifest; one that differs fails the export, before the ledger knows of it.
    """
    spark = df.sparkSession
    line = feed_line(feed, df, run)
    targets = [f"{run.out_dir}/{day}/{sub_dir}" if run.by_day else f"{run.out_dir}/{sub_dir}"]
    if run.backup_dir:
        targets.append(f"{run.backup_dir}/{day}/{sub_dir}")

    numbered = number_rows(df, feed.order_by)
    try:
        total = numbered.total()
        if keys_path and feed.key in df.columns:
            numbered.rows.select(feed.key).write.mode("overwrite").parquet(f"{keys_path}/delivered")
        if not total:
            return 0, None
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = plan_files(stamp_name(feed.file_name, run.now), total, feed.rows_per_file(run.chunk_rows), tasks)
        for target in targets:
            write_files(numbered.rows, line, plan, target, run.compression)
            if target == targets[0]:
                write_manifest(file_manifest(numbered.rows, line, plan, feed.key), target)
            else:
                write_manifest(read_manifest(spark, targets[0]).drop("path"), target)
    finally:
        numbered.release()
    for target in targets[1:]:
        if not check_files(spark, target).where("NOT ok").isEmpty():
            raise RuntimeError(f"backup {target} is not as its manifest tells")
    return total, targets[0]


def day_of(run: ExportRun) -> str:
    return run.now.strftime("%Y%m%d")


def export_full(spark: SparkSession, feed: FeedSpec, run: ExportRun, ledger: Ledger) -> int:
    """Export a feed without a key."""
    sub_dir = f"feed={feed.name}/run={run.now.strftime('%Y%m%d%H%M%S')}"
    rows, path = deliver(feed, feed_rows(spark, feed), run, sub_dir, day_of(run))
    ledger.close(feed.name, None, None, rows, path)
    return rows


def export_incremental(spark: SparkSession, feed: FeedSpec, run: ExportRun, ledger: Ledger) -> int | None:
    """Export keys above the mark up to the table's highest; None when there are no new keys.

    The mark moves only after the write, and also when no row of the range qualifies. A feed
    that was never seeded is seeded instead.
    """
    seeded, start = ledger.position(feed.name)
    if not seeded:
        seed(spark, [feed], ledger)
        return None
    top = highest_key(spark, feed, start)
    if top is None:
        return None
    end, day = ledger.open_range(feed.name, start, top, day_of(run))
    sub_dir = f"feed={feed.name}/start={'none' if start is None else start}/end={end}"
    since = None if start is None else start - feed.overlap
    kept = f"{run.out_dir}/_keys/{sub_dir}/{uuid.uuid4().hex}" if run.keep_keys else None
    if kept:
        # Before the export reads the table: a key committed in between is reported late, unless the export carried it.
        source = spark.table(feed.table).select(feed.key).where(key_range(F.col(feed.key), since, end))
        source.write.parquet(f"{kept}/before")
    rows, path = deliver(feed, feed_rows(spark, feed, since, end), run, sub_dir, day, kept)
    if kept:
        known = spark.read.schema(source.schema).option("recursiveFileLookup", "true").parquet(kept)
        digests_of(ledger).add(feed.name, key_digests(known.where(key_range(F.col(feed.key), start, end)), feed.key), kept)
        ledger.keep_keys(feed.name, start, end, kept)
    ledger.close(feed.name, start, end, rows, path)
    return rows


def digests_of(ledger: Ledger) -> KeyDigests:
    """The digests that belong to a ledger; their folder is passed over by the ledger's own reads."""
    return KeyDigests(ledger.spark, f"{ledger.path}/_digests")


def audit_late_keys(spark: SparkSession, feed: FeedSpec, run: ExportRun, ledger: Ledger, after: int | None = None) -> DataFrame:
    """Keys of the feed's table within the ranges exported with ``keep_keys`` that neither were there just before their export
    read it nor were delivered by it: they were committed late. Ranges whose keys were not kept are left out, and with
    ``after`` all ranges that end at or before that key.

    The table's keys are reduced to a digest per block of keys and compared with the digests kept of the ranges. Keys that
    were kept are read for the ranges that meet a block which differs, and for no others; a clean audit reads none. Keys
    that have vanished since make a block differ as well, and are not reported.
    """
    source = spark.table(feed.table)
    kept = ledger.kept_keys(feed.name)
    if after is not None:
        kept = kept.where(F.col("end_key") > after)
    low = F.coalesce("start_key", F.lit(LOWEST_KEY))
    by_end = W.orderBy("high")
    ranges = kept.select(low.alias("low"), F.col("end_key").alias("high"), "path")
    runs = (
        ranges.withColumn("new", (F.col("low") > F.lag("high", 1, LOWEST_KEY).over(by_end)).cast("int"))
        .withColumn("run", F.sum("new").over(by_end))
        .groupBy("run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    if not runs:
        return source.select(feed.key).limit(0)
    audited = reduce(or_, [key_range(F.col(feed.key), None if r["low"] == LOWEST_KEY else r["low"], r["high"]) for r in runs])
    now = source.select(feed.key).where(audited)
    told = digests_of(ledger).read().where(F.col("feed") == feed.name).join(ranges.select("path"), "path", "left_semi")
    blocks = differing_blocks(key_digests(now, feed.key), told)
    stage = fresh_dir(spark, "differing")
    blocks.write.parquet(stage)
    blocks = spark.read.schema(blocks.schema).parquet(stage)
    bounds = blocks.agg(F.min("block"), F.max("block")).first()
    if bounds[0] is None:
        return now.limit(0)
    # Ranges with keys in a differing block: these are opened.
    paths = [r["path"] for r in told.join(blocks, "block", "left_semi").select("path").distinct().collect()]
    read = spark.read.schema(now.schema).option("recursiveFileLookup", "true")
    known = read.parquet(*paths) if paths else now.limit(0)
    in_blocks = now.join(blocks, key_block(F.col(feed.key)) == F.col("block"), "left_semi")
    first = bounds[0] << BLOCK_BITS
    return late_keys(in_blocks, known, feed.key, (bounds[1] + 1 << BLOCK_BITS) - 1, max(first - 1, LOWEST_KEY if after is None else after))


def read_delivered(spark: SparkSession, feed: str, ledger: Ledger) -> DataFrame:
    """Lines of a feed's delivered files with ``file_name`` and ``position``; files the ledger does not know are not read."""
    return read_files(spark, ledger.paths(feed))


def delivered_manifest(spark: SparkSession, feed: str, ledger: Ledger) -> DataFrame:
    """What the manifests tell of a feed's delivered files: name, rows, lines, bytes, checksum and key bounds of each."""
    return read_manifest(spark, ledger.paths(feed))


def is_due(ledger: Ledger, now: datetime, interval_seconds: int) -> bool:
    """Whether the latest run or delivery lies at least the interval back."""
    last = ledger.last_run()
    return last is None or abs((now.astimezone(timezone.utc) - last).total_seconds()) >= interval_seconds


def run_catalogue(spark: SparkSession, feeds: list[FeedSpec], run: ExportRun, ledger: Ledger) -> dict[str, int]:
    """Run the enabled feeds in order, or several at a time; rows per feed that exported.

    The first run ever seeds the keyed feeds and exports nothing. A run that comes before the
    interval since the latest run has passed does nothing. Every other run is recorded, also one
    that had nothing to export.
    """
    if not ledger.started([feed.name for feed in feeds]):
        seed(spark, feeds, ledger)
        ledger.record_run()
        return {}
    if not is_due(ledger, run.now, run.interval_seconds):
        return {}
    def export(feed: FeedSpec) -> int | None:
        return (export_incremental if feed.incremental else export_full)(spark, feed, run, ledger)

    enabled = [feed for feed in feeds if feed.enabled]
    with ThreadPoolExecutor(run.parallel) as pool:
        delivered = dict(zip([feed.name for feed in enabled], pool.map(export, enabled)))
    ledger.record_run()
    return {name: rows for name, rows in delivered.items() if rows is not None}
