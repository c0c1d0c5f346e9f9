"""Copying tables: by key range, or in full as versions of which the ledger names the current one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from feedmill.operators.keys import key_range, max_key
from feedmill.session import drop_dir, list_folders
from feedmill.sinks.ledger import Ledger

# Beside the ranges: a table without rows, which tells the columns before the first range is there.
COLUMNS = "_columns"
RANGE = ("_start", "_end")


def sync_incremental(source: DataFrame, name: str, key: str, target_dir: str, ledger: Ledger) -> int | None:
    """Append the rows above the mark to the target; None when there are none.

    Each range is a partition of its own, replaced if the same range is copied again.
    """
    spark = source.sparkSession
    start = ledger.mark(name)
    if not _has_columns(spark, target_dir):
        source.limit(0).write.mode("ignore").parquet(f"{target_dir}/{COLUMNS}")
    top = max_key(source, key, above=start)
    if top is None:
        return None
    end, _ = ledger.open_range(name, start, top)
    path = f"{target_dir}/{RANGE[0]}={'none' if start is None else start}/{RANGE[1]}={end}"
    fresh = source.where(key_range(F.col(key), start, end))
    fresh.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(source.schema).parquet(path).count()
    ledger.close(name, start, end, rows, path)
    return rows


def _has_columns(spark: SparkSession, target_dir: str) -> bool:
    try:
        spark.read.parquet(f"{target_dir}/{COLUMNS}")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def read_synced(spark: SparkSession, name: str, target_dir: str, ledger: Ledger) -> DataFrame:
    """The target table: delivered ranges only, none before the first of them.

    The ranges are partitions that are joined with the ledger, so the ledger's entries choose the folders that are read
    while the query runs, and no list of paths is made.
    """
    columns = spark.read.parquet(f"{target_dir}/{COLUMNS}").schema
    if not list_folders(spark, target_dir, f"{RANGE[0]}="):
        return spark.createDataFrame([], columns)
    ranged = StructType(columns.fields)
    for field in RANGE:
        ranged = ranged.add(field, StringType())
    copied = spark.read.schema(ranged).parquet(target_dir)
    start = F.coalesce(F.col("start_key").cast("string"), F.lit("none"))
    done = ledger.done().where((F.col("feed") == name) & F.col("path").isNotNull())
    done = done.select(start.alias(RANGE[0]), F.col("end_key").cast("string").alias(RANGE[1])).distinct()
    return copied.join(done, list(RANGE), "left_semi").select(*columns.names)


def write_version(source: DataFrame, target_dir: str) -> tuple[str, int]:
    """Write a new version of the table beside the others; its path and rows. Nobody reads it before it is named."""
    path = f"{target_dir}/version={uuid.uuid4().hex}"
    source.write.parquet(path)
    return path, source.sparkSession.read.schema(source.schema).parquet(path).count()


def sync_full(source: DataFrame, name: str, target_dir: str, ledger: Ledger, keep: int = 1) -> int:
    """Replace the target with the source: write a version, name it in the ledger, drop versions older than the last ``keep`` ones.

    The entry in the ledger is the moment of the replacement. A run that is lost before it leaves the earlier version in
    place, and a version that nobody names, which a later run drops. Readers of the version before are not disturbed.
    """
    path, rows = write_version(source, target_dir)
    ledger.name_version(name, path, rows)
    vacuum(source.sparkSession, name, target_dir, ledger, keep)
    return rows


def read_full(spark: SparkSession, name: str, ledger: Ledger) -> DataFrame:
    """The current version of a table that is copied in full."""
    paths = ledger.versions(name)
    if not paths:
        raise ValueError(f"{name} was never copied")
    return spark.read.parquet(paths[0])


def vacuum(spark: SparkSession, name: str, target_dir: str, ledger: Ledger, keep: int = 1) -> int:
    """Drop versions that are neither current nor one of the ``keep`` before, and those never named; how many. Not while a copy of
    the same table is being written."""
    held = {path.rpartition("/")[2] for path in ledger.versions(name)[: keep + 1]}
    old = [path for path in list_folders(spark, target_dir, "version=") if path.rpartition("/")[2] not in held]
    for path in old:
        drop_dir(spark, path)
    return len(old)


def jdbc_writer_options(url: str, table: str, batch_rows: int = 10_000, **connection: str) -> dict[str, str]:
    """Options to write into a database instead: df.write.format('jdbc').options(...)."""
    return {"url": url, "dbtable": table, "batchsize": str(batch_rows), **connection}
