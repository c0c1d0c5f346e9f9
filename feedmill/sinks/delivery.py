"""Deliveries: files of a fixed number of rows in one folder, and the manifest that names and proves them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.sinks.delimited import chunk_name

# Beside the files, in a folder that readers of the files pass over.
MANIFEST = "_manifest"
MANIFEST_SCHEMA = (
    "file_name string, part int, piece int, first_row long, rows long, lines long, bytes long, checksum long,"
    " min_key long, max_key long"
)
# Rows of an unsplit result that are written as one part at least.
UNSPLIT_ROWS = 100_000
PART_NAME = r"^part-(\d+)-.*-c(\d+)[^/]*$"


@dataclass(frozen=True)
class FilePlan:
    """Which rows make up which file. Each task writes one part, cut into pieces of ``per_piece`` rows; a piece is a file.

    An unsplit result is one file in several parts that follow each other."""

    name: str
    split: bool
    per_piece: int
    pieces: int
    pieces_per_part: int

    @property
    def parts(self) -> int:
        return -(-self.pieces // self.pieces_per_part)

    def part(self) -> Column:
        return F.expr(f"cast((rn - 1) div {self.per_piece} div {self.pieces_per_part} as int)")

    def piece(self) -> Column:
        return F.expr(f"cast((rn - 1) div {self.per_piece} % {self.pieces_per_part} as int)")

    def file_name(self) -> Column:
        number = F.expr(f"(rn - 1) div {self.per_piece} + 1") if self.split else F.lit(0).cast("long")
        return chunk_name(self.name, number)


def plan_files(name: str, total: int, per_file: int, tasks: int) -> FilePlan:
    """Files of ``per_file`` rows, written by ``tasks`` tasks at most; a result of no more rows is one file without a number.

    With ``per_file`` 0 the result is unsplit: one file, of as many parts as tasks may write."""
    if 0 < per_file < total:
        files = -(-total // per_file)
        return FilePlan(name, True, per_file, files, -(-files // min(files, tasks)))
    parts = 1 if per_file else max(1, min(tasks, -(-total // UNSPLIT_ROWS)))
    per_part = max(1, -(-total // parts))
    return FilePlan(name, False, per_part, max(1, -(-total // per_part)), 1)


def _line_hashes(line: Column) -> Column:
    """Sum of the upper half of each physical line's hash, so that the sum of a file fits a long."""
    hashes = F.transform(F.split(line, "\n", -1), lambda x: F.shiftright(F.xxhash64(x), 32))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, b: a + b)


def file_manifest(rows: DataFrame, line: Column, plan: FilePlan, key: str | None = None) -> DataFrame:
    """One row per file (or part of an unsplit one): name, place, rows, physical lines, bytes, checksum and key bounds."""
    bound = F.col(key).cast("long") if key and key in rows.columns else F.lit(None).cast("long")
    told = rows.select(
        plan.file_name().alias("file_name"),
        plan.part().alias("part"),
        plan.piece().alias("piece"),
        "rn",
        line.alias("_line"),
        bound.alias("_key"),
    )
    return told.groupBy("file_name", "part", "piece").agg(
        F.min("rn").alias("first_row"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.size(F.split("_line", "\n", -1)).cast("long")).alias("lines"),
        F.sum(F.octet_length("_line").cast("long") + 1).alias("bytes"),
        F.sum(_line_hashes(F.col("_line"))).alias("checksum"),
        F.min("_key").alias("min_key"),
        F.max("_key").alias("max_key"),
    )


def write_files(rows: DataFrame, line: Column, plan: FilePlan, path: str, compression: str = "none") -> None:
    """Write numbered rows as the files of the plan, all in one folder, which is replaced.

    Rows go straight to the task of their part, one exchange by number; the writer cuts the part's sorted rows into pieces. So
    neither folders nor tasks grow with the number of files.
    """
    (
        rows.select(plan.part().alias("part"), "rn", line.alias("line"))
        .repartitionById(plan.parts, F.col("part"))
        .sortWithinPartitions("rn")
        .select("line")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", plan.per_piece)
        .option("compression", compression)
        .text(path)
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Put a manifest beside the files it tells of."""
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Manifests of delivered folders, each row with its folder ``path``."""
    own = [paths] if isinstance(paths, str) else paths
    if not own:
        return spark.createDataFrame([], f"{MANIFEST_SCHEMA}, path string")
    read = spark.read.schema(MANIFEST_SCHEMA).parquet(*[f"{p}/{MANIFEST}" for p in own])
    return read.withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), f"^(.*)/{MANIFEST}/", 1))


def read_parts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Physical lines of delivered folders: path, part, piece and ``at``, the place in the file, from 1."""
    name = F.col("_metadata.file_name")
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").alias("line"),
        F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("path"),
        F.regexp_extract(name, PART_NAME, 1).cast("int").alias("part"),
        F.regexp_extract(name, PART_NAME, 2).cast("int").alias("piece"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_scan"),
    )
    in_file = W.partitionBy("path", "part", "piece").orderBy("_block", "_scan")
    return lines.withColumn("at", F.row_number().over(in_file)).drop("_block", "_scan")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of delivered files: ``file_name``, ``position`` in the file from 1, and ``line``. Files that no manifest names are not read.

    Positions count physical lines; rows hold one each unless a value has a line end in it."""
    if not paths:
        return spark.createDataFrame([], "file_name string, position long, line string, path string")
    named = read_manifest(spark, paths)
    before = W.partitionBy("path", "file_name").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    starts = named.select(
        F.col("path").alias("_path"),
        F.col("part").alias("_part"),
        F.col("piece").alias("_piece"),
        "file_name",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("_start"),
    )
    lines = read_parts(spark, paths)
    same = (F.col("path") == F.col("_path")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
    return lines.join(starts, same).select("file_name", (F.col("_start") + F.col("at")).alias("position"), "line", "path")


def check_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """For each file of the manifests, and each one found that none names: whether lines and checksum are as told."""
    named = read_manifest(spark, paths)
    found = (
        read_parts(spark, paths)
        .groupBy(F.col("path").alias("_path"), F.col("part").alias("_part"), F.col("piece").alias("_piece"))
        .agg(F.count(F.lit(1)).alias("found_lines"), F.sum(F.shiftright(F.xxhash64("line"), 32)).alias("found_checksum"))
    )
    same = (F.col("path") == F.col("_path")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
    as_told = F.col("lines").eqNullSafe(F.col("found_lines")) & F.col("checksum").eqNullSafe(F.col("found_checksum"))
    return named.join(found, same, "full").select(
        F.coalesce("path", "_path").alias("path"),
        "file_name",
        F.coalesce("part", "_part").alias("part"),
        F.coalesce("piece", "_piece").alias("piece"),
        "rows",
        as_told.alias("ok"),
    )
