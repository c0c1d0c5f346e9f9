"""Licence scan with a positional rare-token index.

Templates are licence phrases. Each is indexed by its words of highest IDF over the corpus, with their places in the
template. A file's words are looked up in that index; postings that agree on where the template would start are
verified there: the mandatory key phrase must stand word for word, and enough IDF weight of the whole template.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A candidate is one number: template * SPAN + start + the longest template's length, as a start may be before the text.
SPAN = 1 << 40


@dataclass(frozen=True)
class Template:
    """A licence phrase; ``key`` is the part that must stand word for word (default: all of it)."""

    label: str
    phrase: str
    key: str = ""
    base: bool = False
    least: float = 0.75

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def key_words(self) -> list[str]:
        return (self.key or self.phrase).split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

# Notices of public licences, lower-cased words.
NOTICES = (
    Template("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
)


def text_words(text: Column) -> Column:
    """Words of letters A-Z (lower-cased), digits and all non-ASCII characters; NULL has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    spaced = F.trim(F.regexp_replace(lower, SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def licence_idf(words: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """IDF of the templates' words over all documents of ``words`` (a column ``words``).

    Only counts of the templates' own vocabulary reach the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    # One more row per document, of a word no text has, counts the documents.
    counted = words.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counted.toLocalIterator()}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def rare_words(template: Template, idf: dict[str, float], count: int) -> list[str]:
    return sorted(set(template.words), key=lambda w: (-idf[w], w))[:count]


def _literal_templates(templates: Sequence[Template], idf: dict[str, float]) -> Column:
    def row(t: Template) -> Column:
        weights = [idf[w] for w in t.words]
        return F.struct(
            F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"),
            F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*map(F.lit, weights)).alias("weights"),
            F.lit(sum(weights)).alias("weight"),
            F.lit(t.key_at).alias("key_at"),
            F.array(*map(F.lit, t.key_words)).alias("key"),
            F.lit(1.0 if t.base else t.least).alias("least"),
        )

    return F.array(*map(row, templates))


def _literal_postings(templates: Sequence[Template], idf: dict[str, float], anchors: int) -> Column:
    return F.array(
        *[
            F.struct(F.lit(word).alias("word"), F.lit(number).cast("long").alias("template"), F.lit(at).alias("at"), F.lit(at - t.key_at).alias("after_key"))
            for number, t in enumerate(templates)
            for word in rare_words(t, idf, 1 if t.base else anchors)
            for at in range(len(t.words))
            if t.words[at] == word
        ]
    )


def scan_licences(
    df: DataFrame, text: str = "text", base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, anchors: int = 2
) -> DataFrame:
    """Add to each row ``n_words``, ``places`` (label, start, base, score of each match), ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels`` and ``score``, replacing columns of these names.

    Rows are judged on their own, without a shuffle; a scan before that counts the licence words. Base phrases match word for
    word, found by their rarest word; notices by any of their ``anchors`` rarest words, if the key phrase stands whole
    and ``least`` of the IDF weight is in place. A notice whose lead words are missing before the text's first word has a
    ``start`` below 0. NULL and empty texts have no words and no label; repeated rows stay.
    """
    templates = [*base, *notices]
    added = ("n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in df.columns if c not in added]
    read = df.select(*kept).withColumn("_words", text_words(F.col(text)))
    idf = licence_idf(df.select(text_words(F.col(text)).alias("words")), templates)
    index = sorted({w for t in templates for w in rare_words(t, idf, 1 if t.base else anchors)})

    words, tables = F.col("_words"), _literal_templates(templates, idf)
    postings = _literal_postings(templates, idf, anchors)
    longest = max((len(t.words) for t in templates), default=0)
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(index), i)), lambda i: i.isNotNull())

    def starts(i: Column) -> Column:
        own = F.filter(postings, lambda p: (p["word"] == F.get(words, i)) & (p["after_key"] <= i))
        return F.transform(own, lambda p: p["template"] * F.lit(SPAN) + (i - p["at"] + longest))

    candidates = F.array_distinct(F.flatten(F.transform(F.col("_hits"), starts)))

    def verified(c: Column) -> Column:
        t = F.get(tables, F.shiftright(c, 40).cast("int"))
        start = (c % F.lit(SPAN)).cast("int") - longest
        weight = F.aggregate(
            F.sequence(F.lit(0), F.size(t["words"]) - 1),
            F.lit(0.0),
            lambda sum_, j: sum_
            + F.when(F.get(words, start + j) == F.get(t["words"], j), F.get(t["weights"], j)).otherwise(F.lit(0.0)),
        )
        score = F.least(weight / t["weight"], F.lit(1.0))
        here = F.slice(words, start + t["key_at"] + 1, F.size(t["key"])) == t["key"]
        return F.when(
            here & (score >= t["least"] - 1e-9),
            F.struct(t["label"].alias("label"), start.cast("long").alias("start"), t["base"].alias("base"), score.alias("score")),
        )

    found = F.filter(F.transform(F.col("_candidates"), verified), lambda p: p.isNotNull())
    based = F.filter("places", lambda p: p["base"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")

    return (
        read.withColumn("_hits", hits)
        .withColumn("_candidates", candidates)
        .withColumn("places", found)
        .withColumn("_based", based)
        .select(
            *kept,
            F.size("_words").cast("long").alias("n_words"),
            "places",
            F.size("_based").cast("long").alias("n_base"),
            F.array_min(F.col("_based")["start"]).alias("first_word"),
            F.array_max(F.col("_based")["start"]).alias("last_word"),
            joined(F.col("_based")).alias("base_labels"),
            joined(F.col("places")).alias("labels"),
            F.coalesce(F.array_max(F.col("places")["score"]), F.lit(0.0)).alias("score"),
        )
    )
