"""Running totals in a total order, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.staging import staged
from feedmill.operators.chunks import PARTITION_SHIFT, row_order


def running_totals(
    df: DataFrame, totals: dict[str, str], order_by: Sequence[str], group_by: Sequence[str] = ()
) -> DataFrame:
    """Add, per group, the sum of each value over the group's earlier rows.

    ``totals`` maps new column names to numeric columns. Rows are range-partitioned on group and order, so a
    group with most of the data is cut into segments; sums within a segment need one range partition, and
    the sums of earlier segments one row per segment. NULL sorts last and counts as 0; NULL groups are a
    group of their own; rows equal in the whole order keep an order fixed by the staged table.
    """
    order = row_order([*group_by, *order_by])
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    rows = staged(placed, "running").withColumn("_part", F.shiftright("_pos", PARTITION_SHIFT))
    segments = rows.groupBy(*group_by, "_part").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    earlier = W.partitionBy(*group_by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = staged(
        segments.select(
            *[F.col(c).alias(f"_of_{c}") for c in (*group_by, "_part")],
            *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in totals],
        ),
        "segments",
    )
    within = W.partitionBy(*group_by, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.select(
        "*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{n}") for n, v in totals.items()]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group_by, "_part")]
    return summed.join(bases, same).select(
        *df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in totals]
    )
