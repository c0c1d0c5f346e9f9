"""Moving processed files out of their folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.session import move_paths
from feedmill.sinks.ledger import MoveLog


def archive_files(spark: SparkSession, feed: str, files: DataFrame, archive: str, log: MoveLog) -> int:
    """Move files (path, file_name) to the archive folder, each under its own name; how many moves were made.

    All moves are planned in the log before the first is made, so a run that is lost in between is taken up by
    :func:`finish_moves`.
    """
    target = F.concat(F.lit(archive.rstrip("/") + "/"), "file_name")
    log.record(feed, files.select(F.col("path").alias("source"), target.alias("target")), "planned")
    return finish_moves(spark, feed, log)


def finish_moves(spark: SparkSession, feed: str, log: MoveLog) -> int:
    """Make the moves that were planned and not made. Making one twice does no harm."""
    moves = [tuple(row) for row in log.pending(feed).collect()]
    if not moves:
        return 0
    move_paths(spark, moves)
    log.record(feed, spark.createDataFrame(moves, "source string, target string"), "moved")
    return len(moves)
