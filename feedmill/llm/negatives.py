"""Hard negatives by exact integer inner products, several candidates in one multiplication.

Components become integers. Those of several candidates, biased so that none is negative, are packed into separate fields of
one wide integer, an anchor's components are multiplied with it once each, and the sums of all fields are read out exactly
(Kronecker substitution). Where the fields of a product fit 53 bits the wide integers are held in doubles, whose products
and sums are exact up to there; otherwise they are Python's integers of any width.

Anchors and candidates meet in blocks of bounded size, each pair of blocks in a task of its own, first for the positives of
each anchor and then for its negatives. Only the best of each block leave the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.staging import staged

# Components of a block of candidates, and rows of one; with the place in a block below its score, a key must fit a long.
BLOCK_COMPONENTS = 1 << 19
BLOCK_ROWS = 1 << 13
# Anchors that a block holds, and that are multiplied at a time.
BLOCK_ANCHORS = 2048
ANCHOR_STEP = 256
# Bits up to which doubles hold integers exactly.
DOUBLE_BITS = 53
# Lanes of a wide integer where Python's are used.
WIDE_LANES = 4
LONG = (-(2**63), 2**63 - 1)


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices; of dtype object where they or their parts may exceed a long."""
    (m, d), n = anchors.shape, len(candidates)
    if not m or not n or not d:
        return np.zeros((m, n), np.int64)
    least = [int(side.min()) for side in (anchors, candidates)]
    most = [int(side.max()) for side in (anchors, candidates)]
    largest = d * max(abs(least[0]), abs(most[0])) * max(abs(least[1]), abs(most[1]))
    field = max(1, (d * (most[0] - least[0]) * (most[1] - least[1])).bit_length())
    lanes = DOUBLE_BITS // field
    small = lanes >= 1 and largest < 1 << 49
    if not small:
        lanes = WIDE_LANES
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    a, b = anchors - least[0], candidates - least[1]
    rows = -(-n // lanes)
    padded = np.zeros((rows * lanes, d), dtype=a.dtype)
    padded[:n] = b
    wide = padded[:rows].copy()
    for lane in range(1, lanes):
        wide += padded[lane * rows : (lane + 1) * rows] * (1 << (field * lane))
    if small:
        products = (a.astype(np.float64) @ wide.astype(np.float64).T).astype(np.int64)
    else:
        products = np.dot(a, wide.T)
    mask = (1 << field) - 1
    sums = np.concatenate([(products >> (field * lane)) & mask for lane in range(lanes)], axis=1)[:, :n]
    return sums + least[1] * a.sum(axis=1)[:, None] + least[0] * b.sum(axis=1)[None, :] + d * least[0] * least[1]


def in_order(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, scores from the highest and their places; of equal scores the first place comes first."""
    n = scores.shape[1]
    bits = max(1, n.bit_length())
    keys = np.sort((scores << bits) + (n - 1 - np.arange(n)), axis=1)[:, ::-1]
    return keys >> bits, n - 1 - (keys & ((1 << bits) - 1)).astype(np.int64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def _blocks(keep: Callable, schema: pa.Schema) -> Callable:
    """A task's work on a block of anchors and one of candidates: ``keep`` chooses, for one anchor, among the ordered candidates.

    It gets the anchor's row as a dict, and of all candidates in order scores, whether each is of the anchor's label, and
    row numbers; it returns a list of (group, places)."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return schema.empty_table()
        anchors = anchors.rename_columns([c.removeprefix("a_") for c in anchors.column_names])
        order = pc.sort_indices(candidates, [("key", "ascending"), ("row", "ascending")], null_placement="at_end")
        candidates = candidates.take(order).combine_chunks()
        dim = candidates.column("dim")[0].as_py()
        vectors = _matrix(candidates.column("vector"), dim)
        labels = candidates.column("label").combine_chunks().dictionary_encode()
        names = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
        codes = labels.indices.to_numpy()
        numbers = candidates.column("row").to_numpy()
        own = anchors.drop_columns(["vector"]).to_pylist()
        found: dict[str, list] = {"anchor": [], "part": [], "score": []}
        taken = []
        for at in range(0, len(anchors), ANCHOR_STEP):
            some = own[at : at + ANCHOR_STEP]
            scores = packed_scores(_matrix(anchors.column("vector").slice(at, ANCHOR_STEP), dim), vectors)
            if scores.dtype == object:
                scores = np.clip(scores, *LONG)
            ordered, places = in_order(scores)
            for anchor, score, place in zip(some, ordered, places):
                same = codes[place] == names.get(anchor["label"], -1)
                for part, kept in keep(anchor, score, same, numbers[place]):
                    found["anchor"] += [anchor["row"]] * len(kept)
                    found["part"] += [part] * len(kept)
                    found["score"] += [int(s) for s in score[kept]]
                    taken.append(place[kept])
        taken = np.concatenate([*taken, np.zeros(0, np.int64)])
        columns = {
            "anchor": pa.array(found["anchor"], pa.int64()),
            "part": pa.array(found["part"], pa.int32()),
            "score": pa.array(found["score"], pa.int64()),
            "row": candidates.column("row").take(pa.array(taken)),
            "key": candidates.column("key").take(pa.array(taken)),
        }
        return pa.table(columns).select(schema.names).cast(schema)

    return run


def _keep_positives(most: int) -> Callable:
    def keep(anchor, scores, same, rows):
        return [(0, np.flatnonzero(same & (rows != anchor["row"]))[:most])]

    return keep


def _keep_negatives(most: int, low: int, high: int) -> Callable:
    def keep(anchor, scores, same, rows):
        places = np.flatnonzero(~same)
        own = scores[places].astype(object) if scores.dtype == object or anchor["wide"] else scores[places]
        found = []
        for positive in anchor["positives"]:
            bound = positive["score"]
            start = np.searchsorted(-100 * own, -high * bound, side="left")
            some = places[start : start + most]
            enough = 100 * own[start : start + most] >= low * bound
            found.append((positive["part"], some[enough.astype(bool)]))
        return found

    return keep


def integer_vectors(vector: Column, scale: float = 256) -> Column:
    """Components as floor(scale * x), x as a double; NULL where the vector or a component is NULL or not finite."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(~wrong, whole)


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    For each row for which ``anchors`` holds, and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. First are higher
    scores, the integer inner products of ``integer_vectors``, then smaller keys (NULL last).

    Rows with a NULL label or vector, or a NULL or non-finite component, take no part. Vectors are compared with those of
    their own length, of any length; components and scores beyond a long count as its nearest end. Rows that repeat a key are
    rows of their own, each its own anchor, and positives or negatives of the others. An anchor without positives, and a
    positive without negatives, give no rows, as does an empty table. Other columns are ignored.
    """
    spark = df.sparkSession
    usable = df.select(
        F.col(key).alias("key"),
        F.col(label).alias("label"),
        integer_vectors(F.col(vector), scale).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    ).where("label IS NOT NULL AND vector IS NOT NULL")
    rows = staged(usable.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")

    # How many blocks the vectors of a length make up.
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.lit(BLOCK_COMPONENTS) / F.greatest("dim", F.lit(1)))).cast("long")
    blocks = staged(
        rows.groupBy("dim")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("m"))
        .select(
            F.col("dim").alias("of_dim"),
            F.ceil(F.col("n") / per_block).alias("c_blocks"),
            F.ceil(F.col("m") / F.least(per_block, F.lit(BLOCK_ANCHORS))).alias("a_blocks"),
        ),
        "blocks",
    )
    spread = rows.join(blocks, F.col("dim") == F.col("of_dim"))
    others = "explode(sequence(0L, {}_blocks - 1))"
    candidates = (
        spread.where("a_blocks > 0")
        .withColumn("c", F.pmod(F.xxhash64("row"), F.col("c_blocks")))
        .select("dim", "c", F.expr(others.format("a")).alias("a"), "row", "key", "label", "vector")
        .groupBy("dim", "a", "c")
    )
    asking = spread.where("is_anchor").withColumn("a", F.pmod(F.xxhash64("row"), F.col("a_blocks")))

    def best(extra: DataFrame, names: list[str], keep: Callable, most: int) -> DataFrame:
        """The first ``most`` rows of each anchor and part, over all blocks."""
        schema = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("score", pa.int64()), ("row", pa.int64()), ("key", key_type)])
        asked = extra.select(*[F.col(c).alias(f"a_{c}") for c in ("dim", "a", "row", "label", "vector", *names)], F.expr(others.format("c")).alias("a_c"))
        left = asked.groupBy("a_dim", "a_a", "a_c")
        kind = f"anchor bigint, part int, score bigint, row bigint, key {rows.schema['key'].dataType.simpleString()}"
        found = left.cogroup(candidates).applyInArrow(_blocks(keep, schema), kind)
        first = W.partitionBy("anchor", "part").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)

    key_type = spark.createDataFrame([], rows.select("key").schema).toArrow().schema.field(0).type
    near = staged(best(asking, [], _keep_positives(positives), positives), "positives")
    own = F.struct(F.col("rank").cast("int").alias("part"), "score")
    wide = (F.max(F.abs(F.col("score").cast("decimal(38,0)"))) > 1 << 56).alias("wide")
    lists = staged(near.groupBy("anchor").agg(F.collect_list(own).alias("positives"), wide), "bounds")
    asking = asking.join(lists, F.col("row") == F.col("anchor"))
    far = best(asking, ["positives", "wide"], _keep_negatives(negatives, low, high), negatives)

    mined = far.select("anchor", "part", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    known = near.select(
        F.col("anchor").alias("_anchor"), F.col("rank").alias("_part"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = rows.where("is_anchor").select(F.col("row").alias("_row"), F.col("key").alias("anchor_id"))
    return (
        mined.join(known, (F.col("anchor") == F.col("_anchor")) & (F.col("part") == F.col("_part")))
        .join(ids, F.col("anchor") == F.col("_row"))
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
