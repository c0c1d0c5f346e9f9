"""Delimited text output: one file per chunk, or ordered part files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedmill.operators.chunks import row_order


def stamp_name(template: str, now: datetime) -> str:
    """Fill in ``[DT]`` (yyyyMMddHHmmss) and ``[TS]`` (epoch seconds), each only if it occurs once."""
    for token, value in (("[DT]", now.strftime("%Y%m%d%H%M%S")), ("[TS]", str(int(now.timestamp())))):
        if template.count(token) == 1:
            template = template.replace(token, value)
    return template


def chunk_suffix(chunk: Column) -> Column:
    """``_0001``; numbers above four digits keep all of them."""
    number = chunk.cast("string")
    return F.concat(F.lit("_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def chunk_name(name: str, chunk: Column) -> Column:
    """File name of a chunk: ``_0001`` and so on before the extension, none for chunk 0."""
    stem, dot, extension = name.rpartition(".")
    if not dot:
        stem, extension = name, ""
    suffix = F.when(chunk == 0, F.lit("")).otherwise(chunk_suffix(chunk))
    return F.concat(F.lit(stem), suffix, F.lit(dot + extension))


def write_chunks(
    rows: DataFrame, line: Column, file_name: Column, path: str, compression: str = "none", add: bool = False
) -> None:
    """Write numbered rows as one text file per file name, in ``rn`` order.

    Each file name is a folder holding one part file. All rows of a name meet in one task, so
    names should stand for chunks of bounded size. The path is replaced; with ``add`` only the
    file names written are.
    """
    (
        rows.select(file_name.alias("file_name"), "rn", line.alias("line"))
        .repartition("file_name")
        .sortWithinPartitions("file_name", "rn")
        .select("file_name", "line")
        .write.mode("overwrite")
        .partitionBy("file_name")
        .option("partitionOverwriteMode", "dynamic" if add else "static")
        .option("compression", compression)
        .text(path)
    )


def write_ordered(df: DataFrame, line: Column, order_by: tuple[str, ...], path: str, compression: str = "none") -> int:
    """Write an unsplit result as part files which, in name order, follow the row order; its rows."""
    written = Observation()
    # Observed above the sort: below it, the pass that samples for the sort would count as well.
    ordered = df.orderBy(*row_order(order_by)).observe(written, F.count(F.lit(1)).alias("rows"))
    ordered.select(line.alias("line")).write.mode("overwrite").option("compression", compression).text(path)
    return written.get["rows"]
