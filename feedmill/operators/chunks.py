"""Exact runs of N rows in a total order, without sorting everything in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.session import drop_dir, fresh_dir

# monotonically_increasing_id keeps the partition number above its low 33 bits.
PARTITION_SHIFT = 33


@dataclass
class Numbered:
    """Rows with ``rn``, their number within the group, and ``group_rows``, the group's size.

    ``segments`` has one row per (range partition, group). Both read staged tables, to be
    released when the caller has written its result.
    """

    rows: DataFrame
    segments: DataFrame
    stage: str

    def total(self) -> int:
        return self.segments.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    def release(self) -> None:
        drop_dir(self.rows.sparkSession, self.stage)


def row_order(columns: list[str] | tuple[str, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def number_rows(df: DataFrame, order_by: tuple[str, ...], group_by: tuple[str, ...] = (), written: bool = False) -> Numbered:
    """Number rows from 1 in ``order_by`` within each group; end the order in a unique column.

    ``df`` is computed once, into a staged copy, unless it only reads a ``written`` table, which is the same each time. The copy
    is range-partitioned on group and order, so what Spark samples to place the ranges is the copy, and a group or sort value
    that holds much of the data is cut up by the columns after it. The sorted ranges are staged with each row's place in
    them, because only a written table has the same partitions each time it is read.
    """
    spark = df.sparkSession
    stage = fresh_dir(spark, "numbered")
    order = row_order([*group_by, *order_by])
    source = df
    if not written:
        df.write.parquet(f"{stage}/source")
        source = spark.read.schema(df.schema).parquet(f"{stage}/source")
    placed = (
        source.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed.write.parquet(f"{stage}/rows")
    if not written:
        drop_dir(spark, f"{stage}/source")
    rows = spark.read.schema(placed.schema).parquet(f"{stage}/rows")
    return number_staged(rows, stage, df.columns, group_by)


def number_staged(
    rows: DataFrame, stage: str, columns: list[str], group_by: tuple[str, ...], within: tuple[str, ...] = ()
) -> Numbered:
    """Number staged rows whose ``_pos`` was given, in row order, by monotonically_increasing_id.

    A segment is a run of rows of one group (and one value of ``within``) in one partition.
    Segments of a group follow each other by ``within``, else by partition. Their counts give each
    one's offset, and those are all that ever meets in one task: a count per segment. The rows are
    not shuffled, unless the segments outgrow Spark's broadcast threshold; then no key of the join
    exceeds a partition.
    """
    keys = ("_part", *group_by, *within)
    rows = rows.withColumn("_part", F.shiftright("_pos", PARTITION_SHIFT))
    before = W.partitionBy(*group_by).orderBy(*within, "_part").rowsBetween(W.unboundedPreceding, -1)
    counted = (
        rows.groupBy(*keys)
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("group_rows", F.sum("_n").over(W.partitionBy(*group_by)))
    )
    # Written, so that the join below knows its size.
    counted.write.parquet(f"{stage}/segments")
    segments = rows.sparkSession.read.schema(counted.schema).parquet(f"{stage}/segments")

    side = segments.select(*[F.col(c).alias(f"_of{c}") for c in keys], "_first", "_before", "group_rows")
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in keys]
    numbered = rows.join(side, same).select(
        *columns,
        (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias("rn"),
        "group_rows",
    )
    return Numbered(numbered, segments, stage)


def chunk_column(chunk_rows: int) -> Column:
    """File number of a numbered row: 0 for a result that fits one file, else from 1 up."""
    if chunk_rows == 0:
        return F.lit(0).cast("long")
    number = F.expr(f"(rn - 1) div {chunk_rows} + 1")
    return F.when(F.col("group_rows") <= chunk_rows, F.lit(0).cast("long")).otherwise(number)


def part_column(part_rows: int) -> Column:
    """File number within one converted input file, from 1 up even if there is only one."""
    return F.expr(f"(rn - 1) div {part_rows} + 1")


def manifest(chunked: DataFrame, key: str, group_by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and key bounds of each chunk."""
    return chunked.groupBy(*group_by, "chunk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
    )
