"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic. A word's emission is the sum of learned weights of its hashed identity and prefixes;
transitions link neighbours. Forward-backward gives each word's marginal. Words whose marginal is at least one half are
offending; runs of them are spans, and the marginals of strong words make the document's score.

Labels are per document, so training words are labelled first: in toxic documents, those with a feature that is
frequent there and next to absent from clean ones.
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
from feedmill.llm.text import LOWER, Hashes, Slice, mix, row_of_byte, slices, words_of

# Letters and digits of ASCII and every byte of a longer code point make words.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
# A chain ends with its line, and after so many words.
CHAIN_WORDS = 64
# Marginals below this add nothing to a document's score, however long it is.
STRONG = 0.3
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
TAGGED = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("toxic_words", T.LongType()), T.StructField("spans", SPANS)]
)


@dataclass
class Tokens:
    """Words of a slice, their features as hashes (one column per kind), and the first word of each chain."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray
    chain: np.ndarray


def tokens_of(part: Slice) -> Tokens:
    words = words_of(part, LETTERS)
    hashes = Hashes(LOWER[part.data])
    size = words.end - words.start
    columns = [mix(hashes.span(words.start, words.end) + np.uint64(1))]
    for n in PREFIXES:
        prefix = mix(hashes.span(words.start, np.minimum(words.start + n, words.end)) + np.uint64(n + 1))
        # Shorter words have no such prefix: the whole word stands in.
        columns.append(np.where(size >= n, prefix, columns[0]))
    lines = np.cumsum(part.data == 10)
    n = len(words.start)
    first = np.ones(n, dtype=bool)
    if n:
        line = lines[words.start]
        first[1:] = (words.row[1:] != words.row[:-1]) | (line[1:] != line[:-1])
        heads = np.flatnonzero(first)
        place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        first |= place % CHAIN_WORDS == 0
    return Tokens(words.start, words.end, words.row, np.stack(columns, axis=1), np.flatnonzero(first))


def marginals(emission: np.ndarray, chain: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: P(toxic) of each word, and expected transitions (2 x 2).

    ``emission`` is the log-odds of toxic by word, ``chain`` the first word of each chain, ``trans`` log weights from
    state to state. Chains are worked longest first, so that each step is one vector operation over those still running.
    """
    n = len(emission)
    pairs = np.zeros((2, 2))
    if not n:
        return np.zeros(0), pairs
    length = np.diff(np.append(chain, n))
    order = np.argsort(-length, kind="stable")
    head, length = chain[order], length[order]
    running = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]  # length > t
    odds = np.exp(np.clip(emission, -30, 30))
    weight = np.exp(trans)
    alpha = np.empty(n)  # P(toxic) given the words so far
    at = head
    p = odds[at] * np.exp(start)
    alpha[at] = p / (1 + p)
    for t in range(1, len(running)):
        at = head[: running[t]] + t
        before = alpha[at - 1]
        toxic = odds[at] * ((1 - before) * weight[0, 1] + before * weight[1, 1])
        clean = (1 - before) * weight[0, 0] + before * weight[1, 0]
        alpha[at] = toxic / (toxic + clean)
    beta = np.full(n, 0.5)  # share of toxic in the weight of the words to come
    for t in range(len(running) - 2, -1, -1):
        at = head[: running[t + 1]] + t
        later, odd = beta[at + 1], odds[at + 1]
        toxic = weight[1, 0] * (1 - later) + weight[1, 1] * odd * later
        clean = weight[0, 0] * (1 - later) + weight[0, 1] * odd * later
        beta[at] = toxic / (toxic + clean)
        left = alpha[at]
        joint = [
            [(1 - left) * weight[0, 0] * (1 - later), (1 - left) * weight[0, 1] * odd * later],
            [left * weight[1, 0] * (1 - later), left * weight[1, 1] * odd * later],
        ]
        total = sum(joint[0]) + sum(joint[1])
        pairs += [[(x / total).sum() for x in row] for row in joint]
    toxic = alpha * beta
    return toxic / (toxic + (1 - alpha) * (1 - beta)), pairs


@dataclass(frozen=True)
class ToxicModel:
    bits: int
    weights: np.ndarray
    bias: float
    start: float
    trans: np.ndarray
    odds: tuple[float, float, float]  # a document's log-odds: constant, per log strong words, per strongest word

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[(features >> np.uint64(64 - self.bits)).astype(np.int64)].sum(axis=1) + self.bias

    def tag(self, tokens: Tokens) -> np.ndarray:
        return marginals(self.emission(tokens.features), tokens.chain, self.start, self.trans)[0]

    def tag_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]:
        """Per text: log-odds of toxic, strong mass, offending words, spans as (start, end) in code points."""
        rows = len(column)
        mass, most, words = np.zeros(rows), np.zeros(rows), np.zeros(rows, dtype=np.int64)
        spans: list[list] = [[] for _ in range(rows)]
        before = np.zeros(rows, dtype=np.int64)  # code points in earlier slices of a long text
        for part in slices(column):
            tokens = tokens_of(part)
            p = self.tag(tokens)
            strong = np.flatnonzero(p >= STRONG)
            np.add.at(mass, part.rows[tokens.row[strong]], p[strong])
            np.maximum.at(most, part.rows[tokens.row[strong]], p[strong])
            hits = np.flatnonzero(p >= 0.5)
            points = np.cumsum((part.data & 0xC0) != 0x80)
            base = points[part.row_starts - 1] * (part.row_starts > 0) if len(points) else np.zeros(len(part.rows), np.int64)
            last = None
            for i in hits:
                row = int(part.rows[tokens.row[i]])
                words[row] += 1
                offset = before[row] - base[tokens.row[i]]
                begin = int(points[tokens.start[i]] - 1 + offset)
                end = int(points[tokens.end[i] - 1] + offset)
                if last == (row, i - 1):
                    spans[row][-1]["end"] = end
                else:
                    spans[row].append({"start": begin, "end": end})
                last = (row, i)
            if len(points):
                before[part.rows] += np.bincount(
                    row_of_byte(part)[:-1], weights=(part.data & 0xC0) != 0x80, minlength=len(part.rows)
                ).astype(np.int64)
        constant, per_mass, per_most = self.odds
        return constant + per_mass * np.log1p(mass) + per_most * most, mass, words, spans


def seed_words(
    features: np.ndarray, word: np.ndarray, doc: np.ndarray, labels: np.ndarray, least: int = 5, share: float = 0.02
) -> np.ndarray:
    """Which words have a feature seen in at least ``least`` and ``share`` of the toxic documents, and in next to no clean
    ones (5 % of their rate). (word, doc) are the distinct words of each document."""
    toxic = labels == 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    seeds = np.zeros(len(features), dtype=bool)
    for column in features.T:
        _, kind = np.unique(column, return_inverse=True)
        seen = np.unique(kind[word] * len(labels) + doc)
        of, among = toxic[seen % len(labels)], seen // len(labels)
        in_toxic = np.bincount(among, weights=of, minlength=kind.max() + 1)
        in_clean = np.bincount(among, weights=~of, minlength=kind.max() + 1)
        seeds |= ((in_toxic >= max(least, share * n1)) & (in_clean / n0 <= 0.05 * in_toxic / n1))[kind]
    return seeds


def train(sample: list[tuple[str, int]], prior: tuple[int, int], bits: int = 18, rounds: int = 60, l2: float = 1e-3) -> ToxicModel:
    """Fit to (text, label) pairs by adaptive gradient steps on the chains' log-likelihood, then fit the document's odds
    to the labels. ``prior`` counts all labels of class 0 and 1. With a class missing, every text gets the smoothed share."""
    sample = list(dict.fromkeys(sample))  # copies would make their own words look toxic
    labels = np.array([label for _, label in sample])
    base = float(np.log((prior[1] + 1) / (prior[0] + 1)))
    empty = ToxicModel(bits, np.zeros(1 << bits), -5.0, 0.0, np.zeros((2, 2)), (base, 0.0, 0.0))
    if not len(labels) or labels.min() == labels.max():
        return empty
    # Emissions depend on the word alone: features are kept by distinct word.
    own, docs, chains, known, so_far = [], [], [], {}, 0
    for part in slices(pa.array([text for text, _ in sample], pa.large_string())):
        tokens = tokens_of(part)
        words, example = np.unique(tokens.features[:, 0], return_index=True)
        for word, features in zip(words.tolist(), tokens.features[example]):
            known.setdefault(word, features.copy())
        own.append(tokens.features[:, 0].copy())
        docs.append(part.rows[tokens.row].astype(np.int32))
        chains.append(tokens.chain + so_far)
        so_far += len(tokens.start)
    doc, chain = np.concatenate(docs), np.concatenate(chains)
    words = np.array(sorted(known), dtype=np.uint64)
    if not len(words):
        return empty
    features = np.stack([known[w] for w in words.tolist()])
    kind = np.searchsorted(words, np.concatenate(own)).astype(np.int32)
    pairs = np.unique(kind.astype(np.int64) * len(labels) + doc)
    seeds = seed_words(features, pairs // len(labels), pairs % len(labels), labels)
    target = seeds[kind] & (labels[doc] == 1)
    if not target.any():
        return empty
    buckets = (features >> np.uint64(64 - bits)).astype(np.int64)
    heads = np.zeros(len(target), dtype=bool)
    heads[chain] = True
    follow = ~heads[1:]
    state = target.astype(np.int64)
    counted = np.zeros((2, 2))
    np.add.at(counted, (state[:-1][follow], state[1:][follow]), 1)

    weights, bias, start, trans = np.zeros(1 << bits), -3.0, 0.0, np.zeros((2, 2))
    squares, small = np.full(1 << bits, 1e-8), np.full(6, 1e-8)
    for done in range(rounds):
        emission = (weights[buckets].sum(axis=1) + bias)[kind]
        p, both = marginals(emission, chain, start, trans)
        wrong = np.bincount(kind, weights=target - p, minlength=len(words))
        step = -l2 * weights
        for column in buckets.T:
            step += np.bincount(column, weights=wrong, minlength=1 << bits)
        squares += step * step
        weights += step / np.sqrt(squares)
        rest = np.concatenate([[wrong.sum(), (target - p)[chain].sum()], (counted - both).ravel()])
        small = 0.8 * small + 0.2 * rest * rest
        moves = 0.2 * (1 - done / rounds) * rest / np.sqrt(small)
        bias, start, trans = bias + moves[0], start + moves[1], trans + moves[2:].reshape(2, 2)
    p, _ = marginals((weights[buckets].sum(axis=1) + bias)[kind], chain, start, trans)
    mass, most = np.zeros(len(labels)), np.zeros(len(labels))
    strong = p >= STRONG
    np.add.at(mass, doc[strong], p[strong])
    np.maximum.at(most, doc[strong], p[strong])
    share = np.array([prior[0] + 1, prior[1] + 1]) / np.bincount(labels, minlength=2)
    odds = logistic(np.stack([np.ones(len(labels)), np.log1p(mass), most], axis=1), labels, share[labels])
    return ToxicModel(bits, weights, bias, start, trans, tuple(map(float, odds)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant (first column) is not shrunk."""
    weight = weight / weight.mean()
    shrink = np.full(x.shape[1], l2)
    shrink[0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - shrink * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        beta = beta + np.clip(np.linalg.solve(curve, gradient), -4, 4)
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    label: str = "toxic",
    per_class: int = 1500,
    max_bytes: int = 6_000_000,
) -> ToxicModel:
    """Learn from at most ``per_class`` labelled documents of each class and ``max_bytes`` of their text."""
    sample = labelled_rows(docs, labels, label, allowed, per_class, max_bytes)
    return fit_in_task(sample, partial(train, prior=class_counts(labels, label, allowed)))


def tag_toxic(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Add ``score`` (probability of toxic), ``toxic_words`` and ``spans`` of each whole text, replacing such columns.

    Spans are (start, end) in code points, end excluded. NULL and empty texts have no spans and the score of a text
    without strong words. Rows are judged on their own, so ties and repeated rows do not matter.
    """

    @F.arrow_udf(TAGGED)
    def tagged(texts: pa.Array) -> pa.Array:
        odds, _, words, spans = model.tag_texts(texts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.array(words), pa.array(spans, kind)], names=["score", "toxic_words", "spans"]
        )

    kept = [c for c in df.columns if c not in ("score", "toxic_words", "spans")]
    return df.select(*kept, tagged(F.col(text)).alias("_tagged")).select(*kept, "_tagged.*")
