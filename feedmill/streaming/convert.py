"""Continuous conversion of line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedmill.operators.layouts import Layout
from feedmill.plans.convert import PART_ROWS, convert_batch, convert_lines
from feedmill.sources.line_files import LOG_GLOB, name_matches
from feedmill.spec import LineFormat

# Fixed value: time between polls, unless a feed has its own.
PERIOD = "60 seconds"
# A file is new by its name, however old it is: longer than any file lives.
ANY_AGE = "36500d"


def stream_lines(
    spark: SparkSession, folder: str, prefix: str, archive: str | None = None, max_files: int = 1000
) -> DataFrame:
    """Lines of new files. A file name is processed once, whatever folder it shows up in again;
    processed files are moved to ``archive`` when one is given. Files must appear in the folder
    complete, for instance by a rename."""
    reader = (
        spark.readStream.option("lineSep", "\n")
        .option("pathGlobFilter", LOG_GLOB)
        .option("recursiveFileLookup", "true")
        .option("fileNameOnly", "true")
        .option("maxFileAge", ANY_AGE)
        .option("maxFilesPerTrigger", max_files)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return (
        reader.format("text")
        .load(folder)
        .where(name_matches(F.col("_metadata.file_name"), prefix))
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )


def _trigger(once: bool, period: str) -> dict:
    return {"availableNow": True} if once else {"processingTime": period}


def convert_stream(
    lines: DataFrame, fmt: LineFormat, layout: Layout, out_dir: str, checkpoint: str, codes: str = "", once: bool = False,
    period: str = PERIOD,
) -> StreamingQuery:
    """Convert lines in one pass: ``reason=ok`` holds output lines, other folders the rejects.

    The file sink's log makes the output exactly-once, also after a lost executor or a restart.
    """
    return (
        convert_lines(lines, fmt, layout, codes)
        .select("line", F.coalesce("reason", F.lit("ok")).alias("reason"))
        .writeStream.format("text")
        .partitionBy("reason")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, period))
        .start()
    )


def convert_stream_parts(
    lines: DataFrame, fmt: LineFormat, layout: Layout, out_dir: str, reject_dir: str, checkpoint: str,
    codes: str = "", part_rows: int = PART_ROWS, once: bool = False, period: str = PERIOD,
) -> StreamingQuery:
    """As convert_stream, but with files of exactly ``part_rows`` lines per input file.

    Numbering needs whole batches; a batch that is run again replaces its own folder.
    """

    def convert(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("scan_pos", F.monotonically_increasing_id())
        convert_batch(
            placed, fmt, layout, f"{out_dir}/batch={batch_id}", f"{reject_dir}/batch={batch_id}", codes, part_rows
        )

    return (
        lines.writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once, period))
        .start()
    )
