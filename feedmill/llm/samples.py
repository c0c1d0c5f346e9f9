"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``; NULL for a NULL key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def labelled_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    allowed: Column,
    per_class: int,
    max_bytes: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Whole texts ``_text`` and labels ``_label`` (0 or 1) of up to ``per_class`` documents of each class, ``max_bytes`` in all.

    ``allowed`` says which label rows may be learnt from. Labels are chosen by the hash of their key, so reruns agree;
    a key with several labels counts as its highest, one with several texts has the first of them. Only the chosen keys, at
    most 2 * per_class, are broadcast to find their texts; of each class those that come last in the order of the hash are
    left out where the bytes would not do, so that the choice does not depend on a text.
    """
    chosen = labels.where(allowed & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    chosen = chosen.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    order = (F.xxhash64("_key"), F.col("_key"))
    ids = chosen.where("_label = 1").orderBy(*order).limit(per_class)
    ids = ids.union(chosen.where("_label = 0").orderBy(*order).limit(per_class))
    found = (
        docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .join(F.broadcast(ids), F.col("_id") == F.col("_key"))
        .groupBy("_key", "_label")
        .agg(F.min("_text").alias("_text"))
        .withColumn("_size", F.octet_length("_text").cast("long"))
    )
    so_far = W.partitionBy("_label").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = found.withColumn("_sum", F.sum("_size").over(so_far)).where(F.col("_sum") <= max_bytes // 2)
    return kept.select("_key", "_label", "_text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, max_bytes: int, **names) -> list[tuple[str, int]]:
    """The rows of :func:`labelled_rows` as (text, label), in the order of their hash."""
    rows = labelled_rows(docs, labels, label, allowed, per_class, max_bytes, **names).orderBy(F.xxhash64("_key"), "_key")
    return [(r["_text"], r["_label"]) for r in rows.select("_text", "_label").collect()]


def fit_in_task(rows: DataFrame, train: Callable[[list[tuple[str, int]]], object]) -> object:
    """What ``train`` makes of the sample's (text, label), in the order of their hash.

    The sample is bounded, so one task holds it and trains; the driver only gets the model, and a lost executor costs a repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(train(sample))], pa.binary())], names=["model"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("_key"), "_key").select("_text", "_label")
    made = ordered.mapInArrow(run, "model binary").first()
    # Without rows there may be no task.
    return cloudpickle.loads(bytes(made["model"])) if made else train([])


def class_counts(labels: DataFrame, label: str, allowed: Column, key: str = "doc_id") -> tuple[int, int]:
    """Label rows of class 0 and 1 that may be learnt from."""
    counted = labels.where(allowed & F.col(key).isNotNull()).agg(
        F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones")
    )
    row = counted.first()
    return row["zeros"], row["ones"]
