"""Hard negatives by packed products, against plain Python integers."""

import math

import numpy as np
import pytest
from check_queries import compare, connect
from pyspark.sql import functions as F

from feedmill.llm import negatives

SHAPE = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_the_query_equals_its_sql(spark, sf):
    compare(spark, connect(f"/root/testdata/sf{sf}"), f"/root/testdata/sf{sf}", "op13_kronecker_negatives")


@pytest.mark.parametrize(
    ("low", "high", "dim"), [(-300, 300, 64), (0, 1, 7), (-(2**20), 2**20, 33), (-(2**40), 2**40, 5), (-(2**62), 2**62, 3), (-9, -3, 1), (2**50, 2**50 + 9, 4)]
)
def test_packed_scores_are_exact(low, high, dim):
    random = np.random.default_rng(1)
    for m, n in ((1, 1), (7, 30), (3, 4), (0, 5), (5, 0)):
        a, b = random.integers(low, high, (m, dim), endpoint=True), random.integers(low, high, (n, dim), endpoint=True)
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert negatives.packed_scores(a, b).tolist() == want


def test_several_candidates_share_a_product():
    """Small components leave room for two or more candidates in one double."""
    a = np.full((1, 64), 150)
    assert negatives.DOUBLE_BITS // (64 * 300 * 300).bit_length() == 2
    assert negatives.packed_scores(a, np.full((5, 64), -150)).tolist() == [[-150 * 150 * 64] * 5]


def plain(rows, is_anchor, positives=5, negatives_=10, low=30, high=90):
    """The same by definition, over [(vec_id, label, components)]."""
    used = []
    for i, (key, label, vector) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            used.append((i, key, label, [math.floor(256 * x) for x in vector]))
    found = []
    for i, key, label, vector in used:
        if not is_anchor(key):
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), k, l) for j, k, l, v in used if j != i and len(v) == len(vector)]
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for p, positive, _ in [r for r in scored if r[2] == label][:positives]:
            far = [r for r in scored if r[2] != label and low * p <= 100 * r[0] <= high * p][:negatives_]
            found += [(key, positive, rank, k, p, s) for rank, (s, k, _) in enumerate(far, 1)]
    return sorted(found, key=str)


def mined(spark, rows, is_anchor="vec_id % 10 = 0"):
    df = spark.createDataFrame(rows, SHAPE)
    return sorted((tuple(r) for r in negatives.hard_negatives(df, F.expr(is_anchor)).collect()), key=str)


def random_rows(n, dim, seed, labels=4):
    random = np.random.default_rng(seed)
    return [(i, int(random.integers(labels)), random.normal(0.3, 1, dim).round(2).tolist()) for i in range(n)]


def test_against_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 32)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 8)
    rows = random_rows(200, 12, 3)
    got = mined(spark, rows)
    assert got and got == plain(rows, lambda k: k % 10 == 0)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = random_rows(60, 3, 4, labels=2) + [
        (100, None, [1.0, 1.0, 1.0]),
        (110, 1, None),
        (120, 1, [1.0, None, 1.0]),
        (130, 1, [1.0, float("nan"), 1.0]),
        (140, 1, [1.0, float("inf"), 1.0]),
        (None, 0, [1.0, 1.0, 1.0]),
        (None, 1, [0.6, 0.6, 0.6]),
        (150, 1, []),
        (151, 0, []),
        (160, 1, [2.0, 1.0]),
        (161, 1, [2.0, 1.0]),
        (162, 0, [1.0, 1.0]),
    ]
    rows += [(170, 1, [1.0, 1.0, 1.0])] * 3 + [(k, 0, [0.5, 0.5, 0.5]) for k in range(200, 230)]
    assert mined(spark, rows) == plain(rows, lambda k: k is not None and k % 10 == 0)


def test_a_vector_that_most_rows_have(spark):
    rows = [(i, i % 3, [0.5, 0.5]) for i in range(300)] + [(1000 + i, 1, [0.3, 0.3]) for i in range(5)]
    assert mined(spark, rows, "vec_id % 100 = 0") == plain(rows, lambda k: k % 100 == 0)


def test_huge_components_keep_their_order(spark):
    rows = [(0, 1, [2.0**40, 1.0]), (1, 1, [2.0**41, 1.0]), (2, 0, [2.0**40, 0.0]), (3, 0, [2.0**39 + 1, 5.0]), (4, 0, [1e300, 0.0])]
    df = spark.createDataFrame(rows, SHAPE)
    got = negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert all(abs(r.negative_score) < 2**63 for r in got)


def test_empty_tables_and_other_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []
    rows = random_rows(50, 4, 5)
    df = spark.createDataFrame(rows, SHAPE)
    for name in ("row", "dim", "score", "rank", "anchor", "key", "positive_id", "a", "c"):
        df = df.withColumn(name, F.lit("mine"))
    got = sorted((tuple(r) for r in negatives.hard_negatives(df, F.expr("vec_id % 10 = 0")).collect()), key=str)
    assert got == plain(rows, lambda k: k % 10 == 0)
