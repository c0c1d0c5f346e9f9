"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.staging import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (columns ``a`` and ``b``); the root is the component's smallest node.

    Alternates large-star and small-star steps until nothing changes: each hangs a node's neighbours on the smallest
    one, so the number of links never grows and a long chain halves with each round. Every round is written, so a
    lost executor costs one round. NULL ends are ignored, as are repeated links and links of a node with itself.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = staged(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _mark(edges)
    while True:
        large = _star(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))), above=True)
        large = staged(large, "large-star")
        small = staged(_star(large, above=False), "small-star")
        edges = small
        before, earlier = _mark(edges), before
        if before == earlier:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """The number of links and two sums of their hashes, equal only for equal links."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def _star(pairs: DataFrame, above: bool) -> DataFrame:
    """Link each node's greater neighbours (``above``), or the node and its smaller ones, to the smallest of all."""
    lowest = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(lowest, "u")
    if above:
        found = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select("v", "m").union(lowest.select("u", "m")).toDF("u", "v").where("u > v")
    return found.where("u <> v").distinct()
