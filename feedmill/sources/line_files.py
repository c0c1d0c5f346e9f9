"""Folders of line files, read as a batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.sinks.ledger import name_bucket

LOG_GLOB = "*.[lL][oO][gG]"


def name_matches(file_name: Column, prefix: str) -> Column:
    """Name starts with the prefix (a pattern) and ends in .log, in any letter case."""
    return file_name.rlike(rf"(?i)^{prefix}.*\.log$")


def list_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Non-empty files of the folder that match: path, file_name, modified. No content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", LOG_GLOB)
        .load(folder)
        .where("length > 0")
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("modificationTime").alias("modified"),
        )
        .where(name_matches(F.col("file_name"), prefix))
    )


def read_lines(spark: SparkSession, paths: str | list[str], prefix: str) -> DataFrame:
    """Lines of the matching files, with what is needed to restore their order: the offset of
    the split in its file, and the place in the scan, which reads a split front to back.

    The name test uses the file metadata only, so files that do not match are never opened.
    Lines end at ``\\n`` alone; a ``\\r`` inside a line is data.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("pathGlobFilter", LOG_GLOB)
        .text(paths)
        .where(name_matches(F.col("_metadata.file_name"), prefix))
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("scan_pos"),
        )
    )


def unseen_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose name was never processed; the rest are dropped. Of the names (bucket, file_name) only the parts that the
    files' own fall in are read: the files choose them while the query runs."""
    asked = files.select("file_name", name_bucket(F.col("file_name")).alias("bucket"))
    known = seen.join(asked, ["bucket", "file_name"], "left_semi").select("file_name")
    return files.join(known, "file_name", "left_anti")


def read_unseen(spark: SparkSession, folder: str, prefix: str, seen: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Lines of the files not seen yet, and those files; None when there are none.

    The paths pass through the driver, which lists the folder for any Spark read anyway.
    """
    fresh = unseen_files(list_files(spark, folder, prefix), seen).select("path", "file_name")
    found = [tuple(row) for row in fresh.collect()]
    if not found:
        return None
    # Paths are read as patterns, so characters that mean something there are escaped.
    lines = read_lines(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path, _ in found], prefix)
    return lines, spark.createDataFrame(found, fresh.schema)
