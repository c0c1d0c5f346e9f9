"""The joins feeds use. No broadcast hints: Spark broadcasts a side when its known size is under
spark.sql.autoBroadcastJoinThreshold, and otherwise shuffles, where adaptive execution splits
partitions that one hot key has blown up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_active(facts: DataFrame, dimension: DataFrame, on: Column, active: Column) -> DataFrame:
    """Left join to the active dimension rows; a fact without one stays, with NULLs."""
    return facts.join(dimension.where(active), on, "left")


def repeat_per_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: int = 100_000
) -> DataFrame:
    """Left outer join of which only the left columns are wanted: each left row once per match.

    Only match counts are shuffled, not the right rows. A left row with more than ``block``
    matches is first cut into blocks that are spread over the cluster, so that a hot key is
    neither one task's output nor one long array.
    """
    counts = (
        right.select(F.col(right_key).alias("_match"))
        .where("_match IS NOT NULL")
        .groupBy("_match")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    joined = (
        left.join(counts, F.col(left_key) == F.col("_match"), "left")
        .withColumn("_n", F.coalesce("_n", F.lit(1)))
        .drop("_match")
    )
    few = joined.where(F.col("_n") <= block).select(
        *left.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")
    )
    last_block = F.expr(f"(_n - 1) div {block}")
    in_block = F.least(F.lit(block).cast("long"), F.col("_n") - F.col("_block") * block)
    many = (
        joined.where(F.col("_n") > block)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition(*left.columns, "_block")
        .select(*left.columns, F.explode(F.sequence(F.lit(1).cast("long"), in_block)).alias("_copy"))
    )
    return few.unionByName(many).drop("_copy")


def only_listed(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Rows whose code is in the one-column list."""
    listed = codes.toDF("_listed")
    return df.join(listed, F.col(column) == F.col("_listed"), "left_semi")


def only_codes(df: DataFrame, column: str, codes: str) -> DataFrame:
    """Rows whose code is in a colon list such as ``a:b:c``; an empty list lets all pass."""
    return df.where(F.col(column).isin(codes.split(":"))) if codes else df
