"""Recall of the vector index at its registered parameters, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedmill.llm import ann


def vectors_of(kind, n, dim, seed):
    chance = np.random.default_rng(seed)
    if kind == "random":
        return chance.normal(size=(n, dim))
    centres = chance.normal(size=(60, dim))
    if kind == "clustered":
        return centres[chance.integers(60, size=n)] + chance.normal(size=(n, dim)) * 0.3
    # A third around one centre, some of them copies of each other, the rest without order.
    found = chance.normal(size=(n, dim))
    hot = chance.random(n) < 1 / 3
    found[hot] = centres[0] + chance.normal(size=(hot.sum(), dim)) * 0.2
    found[: n // 10] = found[0]
    return found


@pytest.mark.parametrize("kind", ["random", "clustered", "skewed"])
def test_recall_is_at_least_nine_tenths(spark, kind):
    n, dim = 20_000, 64
    vectors = vectors_of(kind, n, dim, 5).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dim).cast(pa.list_(pa.float32()))})
    got = ann.nearest(spark.createDataFrame(table), F.col("vec_id") % 50 == 0, k=5).toPandas()
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for query, own in got.groupby("query_id"):
        cosine = unit @ unit[query]
        cosine[query] = -2
        fifth = np.sort(cosine)[-5]
        # Of vectors as near as the fifth any will do.
        hits += int((cosine[own.vec_id] >= fifth - 1e-12).sum())
        total += 5
    assert total == 5 * n // 50 and hits / total >= 0.9


def test_probes_fall_where_vectors_are_clustered():
    found = {}
    for kind in ("random", "clustered"):
        vectors = vectors_of(kind, 4000, 32, 6)
        router = ann.learn_parts(vectors[:3600], 9)
        found[kind] = ann.choose_probes(router, vectors[:3600], vectors[3600:], 5, 0.95)
    assert 1 <= found["clustered"] < found["random"] <= 9
