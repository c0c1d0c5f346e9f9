"""Quality classifier on supervised subword embeddings.

Each word and each character n-gram hashes to a learned vector. A document is the mean of the vectors of all its
words and n-grams, and a softmax layer on that mean gives its class. Both are trained together by stochastic gradient descent
in numpy. To score, the layer is folded into the vectors: one number per bucket, averaged over the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.llm.samples import class_counts, fit_in_task, labelled_rows
from feedmill.llm.text import SPACES, Hashes, Slice, mix, row_of_byte, slices, words_of

NGRAMS = (3, 4)
REPEAT = 0x5851F42D4C957F2D


def feature_buckets(part: Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row within the slice, bucket) of every word, and of every n-gram of characters within a word and the blanks beside it.

    A word that repeats the one before it is one more feature, the same for all words.
    """
    words = words_of(part, ~SPACES)
    hashes = Hashes(part.data)
    shift = np.uint64(64 - bits)
    own = hashes.span(words.start, words.end)
    again = np.flatnonzero((own[1:] == own[:-1]) & (words.row[1:] == words.row[:-1])) + 1
    rows = [words.row, words.row[again]]
    found = [mix(own + np.uint64(1)) >> shift, np.full(len(again), REPEAT, np.uint64) >> shift]
    blanks = np.zeros(len(part.data) + 1, dtype=np.int32)
    np.cumsum(SPACES[part.data], out=blanks[1:])
    row = row_of_byte(part)
    # Places where a code point begins.
    begins = np.append(np.flatnonzero((part.data & 0xC0) != 0x80), len(part.data))
    for n in NGRAMS:
        start, end = begins[:-n], begins[n:]
        inner = (blanks[end - 1] == blanks[start + 1]) & (row[start] == row[end - 1])
        start, end = start[inner], end[inner]
        rows.append(row[start])
        found.append(mix(hashes.span(start, end) + np.uint64(n)) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """``scores`` has a log-odds share per bucket; a text's log-odds are ``bias`` plus their mean over its features."""

    bits: int
    scores: np.ndarray
    bias: float

    def log_odds(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(len(column))
        count = np.zeros(len(column))
        for part in slices(column):
            row, bucket = feature_buckets(part, self.bits)
            n = len(part.rows)
            total[part.rows] += np.bincount(row, weights=self.scores[bucket], minlength=n)
            count[part.rows] += np.bincount(row, minlength=n)
        return self.bias + total / np.maximum(count, 1)


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of two parts of a text together."""
    unique, at = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate([one[1], other[1]])).astype(np.int64)


def train(
    sample: list[tuple[str, int]], prior: tuple[int, int], bits: int = 16, dim: int = 8, epochs: int = 6, rate: float = 0.5
) -> QualityModel:
    """Fit vectors and layer to (text, label) pairs. ``prior`` counts all labels of class 0 and 1: the bias is moved
    from the sample's balance to theirs. With a class missing, every text gets the smoothed share of class 1."""
    ones = sum(label for _, label in sample)
    zeros = len(sample) - ones
    base = float(np.log((prior[1] + 1) / (prior[0] + 1)))
    if not ones or not zeros:
        return QualityModel(bits, np.zeros(1 << bits, dtype=np.float32), base)
    bags: list = [None] * len(sample)
    for part in slices(pa.array([text for text, _ in sample], pa.large_string())):
        row, bucket = feature_buckets(part, bits)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(part.rows) + 1))
        for i, number in enumerate(part.rows):
            own = np.unique(bucket[order[cuts[i] : cuts[i + 1]]], return_counts=True)
            bags[number] = own if bags[number] is None else _added(bags[number], own)
    for number, (unique, counts) in enumerate(bags):
        bags[number] = unique, (counts / max(1, counts.sum())).astype(np.float32)
    random = np.random.default_rng(7)
    vectors = ((random.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    layer = np.zeros((2, dim), dtype=np.float32)
    bias = np.array([0.0, np.log(ones / zeros)], dtype=np.float32)
    steps, done = epochs * len(sample), 0
    for _ in range(epochs):
        for i in random.permutation(len(sample)):
            buckets, share = bags[i]
            step = np.float32(rate * (1 - done / steps) + 0.01)
            done += 1
            mean = share @ vectors[buckets] if len(buckets) else np.zeros(dim, np.float32)
            logits = layer @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[sample[i][1]] -= 1
            if len(buckets):
                # Shares sum to one, so the vectors' steps are scaled up to the size of a text's.
                scale = step * np.float32(min(len(buckets), 100))
                vectors[buckets] -= scale * share[:, None] * (error @ layer)[None, :]
            layer -= step * error[:, None] * mean[None, :]
            bias -= np.float32(0.1) * step * error
    scores = vectors @ (layer[1] - layer[0])
    shift = base - np.log((ones + 1) / (zeros + 1))
    return QualityModel(bits, scores.astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    label: str = "quality",
    per_class: int = 1500,
    max_bytes: int = 24_000_000,
) -> QualityModel:
    """Learn from at most ``per_class`` labelled documents of each class and ``max_bytes`` of their text."""
    sample = labelled_rows(docs, labels, label, allowed, per_class, max_bytes)
    return fit_in_task(sample, partial(train, prior=class_counts(labels, label, allowed)))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability of class 1 of each whole text, replacing a column of that name.

    NULL and empty texts get the model's bias alone; rows are judged on their own, so ties and repeated rows do not matter.
    """

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(model.log_odds(texts), -500, 500))))

    return df.withColumn(score, scored(F.col(text)))
