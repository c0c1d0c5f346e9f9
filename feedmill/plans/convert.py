"""Converting line files in batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.operators.chunks import number_staged, part_column
from feedmill.operators.layouts import Layout
from feedmill.operators.validate import judge_lines
from feedmill.plans.archive import archive_files, finish_moves
from feedmill.session import drop_dir, fresh_dir
from feedmill.sinks.delimited import chunk_suffix, write_chunks
from feedmill.sinks.ledger import MoveLog, SeenFiles
from feedmill.sources.line_files import read_unseen
from feedmill.spec import LineFormat

REJECT_SCHEMA = "line string, reason string, file_name string"

# Fixed value: accepted lines per converted file.
PART_ROWS = 5000


@dataclass(frozen=True)
class LineFeed:
    """One folder of line files and how to convert them."""

    name: str
    folder: str
    prefix: str
    fmt: LineFormat
    layout: Callable[[DataFrame], DataFrame]
    codes: str = ""
    part_rows: int = PART_ROWS
    enabled: bool = True
    archive: str | None = None


def convert_lines(lines: DataFrame, fmt: LineFormat, layout: Layout, codes: str = "") -> DataFrame:
    """Each line with its ``reason``; accepted ones are replaced by their output line, in the bytes of the input."""
    judged = judge_lines(lines, fmt, codes).transform(layout)
    # Picked by index, since Spark would not share repeated parts of ``out`` inside a branch.
    line = F.get(F.array("out", "line"), F.when(F.col("reason").isNull(), 0).otherwise(1))
    others = [c for c in lines.columns if c != "line"]
    return judged.select(*others, line.alias("line"), "reason")


def convert_batch(
    lines: DataFrame, fmt: LineFormat, layout: Layout, out_dir: str, reject_dir: str, codes: str = "",
    part_rows: int = PART_ROWS, add: bool = False,
) -> None:
    """Convert a batch of lines into files of ``part_rows`` accepted lines per input file.

    The input is read once. The scan already has the lines in file order, so they are staged as
    they come, accepted ones first within each task, and numbered without a shuffle. The target
    folders are replaced; with ``add`` only what stems from the same input files is.
    """
    spark = lines.sparkSession
    stage = fresh_dir(spark, "converted")
    placed = (
        convert_lines(lines, fmt, layout, codes)
        .withColumn("rejected", F.col("reason").isNotNull())
        .sortWithinPartitions("rejected", "scan_pos")
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    try:
        _write_converted(placed, stage, out_dir, reject_dir, part_rows, add)
    finally:
        drop_dir(spark, stage)


def _write_converted(placed: DataFrame, stage: str, out_dir: str, reject_dir: str, part_rows: int, add: bool) -> None:
    spark = placed.sparkSession
    placed.write.partitionBy("rejected").parquet(f"{stage}/rows")
    staged = spark.read.schema(placed.schema).parquet(f"{stage}/rows")

    good = staged.where("NOT rejected")
    numbered = number_staged(good, stage, ["file_name", "line"], ("file_name",), ("block_start",))
    name = F.concat("file_name", chunk_suffix(part_column(part_rows)), F.lit(".dat"))
    write_chunks(numbered.rows, F.col("line"), name, out_dir, add=add)
    (
        staged.where("rejected")
        .select("file_name", "line", "reason")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if add else "static")
        .partitionBy("file_name")
        .parquet(reject_dir)
    )


def read_rejects(spark: SparkSession, reject_dir: str) -> DataFrame:
    """All rejects below the folder, of any feed or batch; none if nothing was rejected."""
    return spark.read.schema(REJECT_SCHEMA).parquet(reject_dir)


def convert_new_files(
    spark: SparkSession, feed: LineFeed, out_dir: str, reject_dir: str, seen: SeenFiles, moves: MoveLog | None = None
) -> DataFrame | None:
    """Convert the files of a feed whose names were not processed yet; these files, or None.

    Names are remembered after the write. A crash in between converts the same files again, into
    the same output files. With ``moves`` the files of a feed that has an archive are then moved there, and moves that an
    earlier run left behind are made first.
    """
    if moves is not None and feed.archive:
        finish_moves(spark, feed.name, moves)
    found = read_unseen(spark, feed.folder, feed.prefix, seen.names(feed.name))
    if found is None:
        return None
    lines, files = found
    convert_batch(
        lines, feed.fmt, feed.layout, f"{out_dir}/feed={feed.name}", f"{reject_dir}/feed={feed.name}",
        feed.codes, feed.part_rows, add=True,
    )
    seen.add(feed.name, files)
    if moves is not None and feed.archive:
        archive_files(spark, feed.name, files, feed.archive, moves)
    return files


def run_line_feeds(
    spark: SparkSession, feeds: list[LineFeed], out_dir: str, reject_dir: str, seen: SeenFiles, moves: MoveLog | None = None
) -> list[str]:
    """Convert the new files of every enabled feed, in order; names of the feeds that had any."""
    return [
        feed.name
        for feed in feeds
        if feed.enabled and convert_new_files(spark, feed, out_dir, reject_dir, seen, moves) is not None
    ]
