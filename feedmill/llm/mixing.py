"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.running import running_totals
from feedmill.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target``.

    Weights repeat over the sources in code-point order, NULL last. Targets share ``share`` times the
    total by weight; a target stops at ``repeats`` times its source's size, and what it leaves goes to the others
    by weight. That is a water level: target = least(cap, level * weight), with the level found from sums over
    the sources ordered by cap / weight. The windows hold one row per source.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn(
            "capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        )
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
        .withColumn(
            "water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
        )
    )
    target = F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap"))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def queue_documents(
    docs: DataFrame, weights: Sequence[float], share: float, repeats: int, key: str = "doc_id", carried: Sequence[str] = ()
) -> DataFrame:
    """Give each document its place in its source's queue.

    ``docs`` has the key, ``source`` and ``size``. The result adds ``source_size``, ``target``, ``before`` (words
    of the source ahead of it) and ``number`` (its rank there, from 0). A source is shuffled by the digest of its
    keys, so reruns agree. Only these few columns are sorted; a source with most rows is cut by the digest.
    Columns ``carried`` go with each document and order those of equal key and size.
    """
    shuffle = F.md5(F.col(key).cast("string"))
    lean = docs.select(key, "source", "size", *carried, shuffle.alias("_shuffle"), F.lit(1).alias("_one"))
    targets = staged(source_targets(lean, weights, share, repeats), "targets")
    queued = running_totals(lean, {"before": "size", "number": "_one"}, ("_shuffle", key, "size", *carried), ("source",))
    sided = targets.withColumnRenamed("source", "_source")
    return queued.join(sided, F.col("source").eqNullSafe(F.col("_source"))).select(
        key, "source", "size", *carried, "source_size", "target", "before", "number"
    )


def draw(queued: DataFrame, repeats: int, key: str = "doc_id", carried: Sequence[str] = ()) -> DataFrame:
    """Serve the queues in the order of virtual finish time, cumulative source words over target, up to the budget.

    Each row is one draw of a document: ``round`` (0 for its first), ``taken`` words, ``finish``, and
    ``position``, its first word's place in the whole mix. A source's second round follows its first. All draws are sorted
    globally and the stream is cut at the budget, the sum of all targets. At virtual time 1 every source reaches its
    target; the document in service then is served as far as that and finishes there, so the cut falls behind it.
    Documents never drawn stay with a single row of 0 words, so that the plan is whole.
    """
    start = F.col("round") * F.col("source_size") + F.col("before")
    least = F.floor("target")
    in_service = (start < least) & (start + F.col("size") > least)
    rounds = queued.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))))
    finish = F.when(in_service, F.lit(1.0)).otherwise((start + F.col("size")) / F.col("target"))
    served = rounds.select(
        key,
        "source",
        "size",
        *carried,
        "source_size",
        "target",
        "number",
        "round",
        F.when(in_service, least - start).otherwise(F.col("size")).alias("words"),
        F.when(F.col("target") > 0, finish).alias("finish"),
        # Of equal finish times, what reaches its target with it comes before what lies behind.
        (start >= least).alias("behind"),
    )
    stream = running_totals(served, {"position": "words"}, ("finish", "behind", "source", "round", "number", key))
    # One row per source.
    budget = queued.groupBy("source").agg(F.floor(F.first("target")).alias("words")).agg(F.sum("words")).first()[0] or 0
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("position")))
    cut = stream.withColumn("taken", taken.cast("long")).where((F.col("taken") > 0) | (F.col("round") == 0))
    return cut.select(key, "source", "size", *carried, "source_size", "target", "number", "round", "taken", "finish", "position")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    key: str = "doc_id",
    text: str = "text",
    carried: Sequence[str] = (),
) -> DataFrame:
    """Draws of ``docs`` (key, ``source``, text) that bring each source to its target; see :func:`draw`.

    Empty and NULL texts have size 0 and are never drawn; an empty table gives no rows; repeated rows queue one
    behind the other; NULL sources are one source, the last; NULL keys queue last; columns ``carried`` go with each draw, other columns are ignored.
    """
    sized = docs.select(F.col(key), F.col("source"), word_count(F.col(text)).alias("size"), *carried)
    return draw(queue_documents(sized, weights, share, repeats, key, carried), repeats, key, carried)


def taken_per_document(draws: DataFrame, key: str = "doc_id", carried: Sequence[str] = ()) -> DataFrame:
    """Words each document gives to the mix, over all its draws, with the columns it has ``carried``."""
    return draws.groupBy(key, "source", "number").agg(
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("taken").alias("taken"),
        F.sum(F.when(F.col("taken") > 0, 1).otherwise(0)).alias("draws"),
        *[F.first(c).alias(c) for c in carried],
    )
