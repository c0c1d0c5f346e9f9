"""Token counts: an exact histogram of encoded lengths, and suffix sums over it."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.running import running_totals
from feedmill.llm.staging import staged

# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Runs of white space from this length on are taken out of a text: the splitting pattern would recurse over them.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class _Encoders(dict):
    """Encoders of a process by vocabulary; left behind when the function that uses them is sent to a task."""

    def __reduce__(self):
        return _Encoders, ()


_ENCODERS: dict = _Encoders()


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """The byte-pair encoder of a rank file's bytes (lines of base64 token and rank)."""
    import tiktoken

    name = hash((vocabulary, pattern))
    if name not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(f"v{name}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def encoded_length(text: str, own) -> int:
    """Tokens of a whole text.

    The pattern takes a run of white space but for its last character as one piece, or all of it at the end of a text, so a
    very long run is encoded by itself just there."""
    n, at = 0, 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(own.encode_ordinary(text[at : run.start()])) + len(own._encode_single_piece(text[run.start() : end].encode()))
        at = end
    return n + len(own.encode_ordinary(text[at:]))


def count_tokens(df: DataFrame, vocabulary: bytes, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Add the encoded length of each whole text, replacing a column of that name; NULL and empty texts have 0.

    Texts of any length are encoded whole. Strings that look like special tokens are ordinary text. The vocabulary travels with the job.
    """

    @F.arrow_udf("bigint")
    def encoded(texts: pa.Array) -> pa.Array:
        own = encoder(vocabulary)
        return pa.array([encoded_length(t.as_py(), own) if t.is_valid else 0 for t in texts], pa.int64())

    return df.withColumn(count, encoded(F.col(text)))


def length_histogram(counted: DataFrame, count: str = "n_tokens") -> DataFrame:
    """Documents of each length, summed in each task before they are shuffled."""
    return counted.groupBy(F.col(count).alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def length_curve(histogram: DataFrame) -> DataFrame:
    """Suffix sums, one row for each length that occurs.

    ``docs``, and of longer documents ``longer_docs`` and ``longer_tokens``; with the context limit at this length
    ``truncated_total`` tokens remain and ``whole_share`` of the documents stay whole. An empty histogram gives no rows.
    """
    kept = staged(
        histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), (-F.col("length")).alias("_down")),
        "histogram",
    )
    total = kept.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    curve = running_totals(kept, {"longer_docs": "docs", "longer_tokens": "tokens"}, ("_down",))
    return curve.select(
        "length",
        "docs",
        "longer_docs",
        "longer_tokens",
        (F.lit(total["tokens"] or 0) - F.col("longer_tokens") + F.col("length") * F.col("longer_docs")).alias("truncated_total"),
        (1 - F.col("longer_docs") / F.lit(float(total["docs"] or 1))).alias("whole_share"),
    )


def at_limits(curve: DataFrame, limits: Sequence[int]) -> dict[int, dict]:
    """For each context limit, the documents and tokens that are kept whole, cut, and left after truncation."""
    total = F.sum(F.col("length") * F.col("docs"))
    asked = [
        F.struct(
            F.coalesce(F.sum(F.when(F.col("length") <= n, F.col("docs"))), F.lit(0)).alias("whole_docs"),
            F.coalesce(F.max_by("longer_docs", F.when(F.col("length") <= n, F.col("length"))), F.sum("docs"), F.lit(0)).alias("cut_docs"),
            F.coalesce(F.max_by("longer_tokens", F.when(F.col("length") <= n, F.col("length"))), total, F.lit(0)).alias("cut_tokens"),
        ).alias(f"l{n}")
        for n in limits
    ]
    row = curve.agg(F.coalesce(total, F.lit(0)).alias("total"), *asked).first()
    return {
        n: {
            "whole_docs": row[f"l{n}"]["whole_docs"],
            "cut_docs": row[f"l{n}"]["cut_docs"],
            "truncated_total": row["total"] - row[f"l{n}"]["cut_tokens"] + n * row[f"l{n}"]["cut_docs"],
        }
        for n in limits
    }


def quantiles(curve: DataFrame, shares: Sequence[float]) -> list[int | None]:
    """The smallest length that at least each share of the documents does not exceed."""
    asked = [F.min(F.when(F.col("whole_share") >= q - 1e-12, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = curve.agg(*asked).first()
    return [row[f"q{i}"] for i in range(len(shares))]
