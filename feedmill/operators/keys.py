"""Key ranges and totals of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of a block share all but their last bits.
BLOCK_BITS = 16


def key_range(key: Column, start: int | None, end: int) -> Column:
    """start < key <= end; no start means from the beginning."""
    upper = key <= F.lit(end)
    return upper if start is None else (key > F.lit(start)) & upper


def max_key(df: DataFrame, key: str, above: int | None = None) -> int | None:
    """Highest key, or None if there is none (above a mark).

    With a mark, files and row groups without newer keys are skipped by their statistics.
    """
    newer = df if above is None else df.where(F.col(key) > above)
    return newer.agg(F.max(key)).first()[0]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def late_keys(source: DataFrame, exported: DataFrame, key: str, mark: int, after: int | None = None) -> DataFrame:
    """Keys at or below the mark that no export has carried: they were committed too late.

    ``after`` bounds the audit from below, so that a regular audit reads only recent ranges.
    """
    window = key_range(F.col(key), after, mark)
    return source.select(key).where(window).join(exported.select(key).where(window), key, "left_anti")


def key_block(key: Column) -> Column:
    return F.shiftright(key.cast("long"), BLOCK_BITS)


def key_digests(keys: DataFrame, key: str) -> DataFrame:
    """One row per block of distinct keys: how many, and a sum of hashes that does not depend on their order."""
    own = keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    return own.groupBy(key_block(F.col("key")).alias("block")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.shiftright(F.xxhash64("key"), 24)).alias("digest")
    )


def differing_blocks(now: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks whose digests are not equal, or that only one side has. Digests of one block that were taken apart add up."""
    sums = [side.groupBy("block").agg(F.sum("keys").alias("keys"), F.sum("digest").alias("digest")) for side in (now, known)]
    known = sums[1].toDF("_block", "_keys", "_digest")
    same = F.col("keys").eqNullSafe(F.col("_keys")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return sums[0].join(known, F.col("block") == F.col("_block"), "full").where(~same).select(F.coalesce("block", "_block").alias("block"))
