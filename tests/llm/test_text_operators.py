"""Scores, licences, tokens and leaks on odd rows: NULL, empty, very long, repeated, clashing columns, no rows."""

import base64

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedmill.llm import decontam, licences, quality, samples, text, tokens, toxicity

ODD = [(1, None), (2, ""), (None, "plain words here"), (4, "plain words here"), (4, "plain words here"), (5, "é" * 30_000 + " end")]
SCHEMA = "doc_id long, text string"


def noisy(i):
    return " ".join(f"w{(i * 7 + k) % 50}" for k in range(30))


@pytest.fixture(scope="module")
def trained():
    sample = [(noisy(i), 1) for i in range(40)] + [(noisy(i).replace(" ", "*** "), 0) for i in range(40)]
    return quality.train(sample, (40, 40))


@pytest.fixture(scope="module")
def toxic_model():
    sample = [(noisy(i), 0) for i in range(60)] + [(noisy(i) + " idiot " + noisy(i + 1), 1) for i in range(30)]
    return toxicity.train(sample, (60, 30))


def test_words_of_a_long_text_do_not_depend_on_slices():
    words = [f"word{i}é" for i in range(3000)]
    column = pa.array([None, " ".join(words), "", "a b"])

    def hashes(size):
        found = []
        for part in text.slices(column, size):
            own = text.words_of(part, ~text.SPACES)
            spans = text.mix(text.Hashes(part.data).span(own.start, own.end))
            found += list(zip(part.rows[own.row].tolist(), spans.tolist()))
        return found

    assert hashes(1 << 20) == hashes(100) == hashes(7)
    assert len(hashes(1 << 20)) == 3002


def test_quality_scores_odd_rows(spark, trained):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("old"))
    got = quality.score_quality(df, trained).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "plain words here"}) == 1
    assert quality.score_quality(df.limit(0), trained).count() == 0


def test_quality_without_labels_gives_the_base_rate(spark):
    model = quality.train([], (0, 0))
    assert model.log_odds(pa.array(["a", None])).tolist() == [0.0, 0.0]
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none, F.lit(True)).bias == 0.0
    assert toxicity.fit(docs, none, F.lit(True)).odds[0] == 0.0


def test_sample_is_bounded_and_keeps_whole_texts(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (0, None), (2, 1), (2, 0)], "doc_id long, quality int")
    got = samples.labelled_sample(docs, labels, "quality", F.lit(True), per_class=10, max_bytes=1200)
    assert len(got) <= 20 and sum(len(t) for t, _ in got) <= 1200 and {t for t, _ in got} == {"x" * 100}


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(0)
    emission, trans, start = random.normal(size=7), random.normal(size=(2, 2)), 0.3
    got, pairs = toxicity.marginals(emission, np.array([0, 4]), start, trans)
    for at, end in ((0, 4), (4, 7)):
        own, total, want = emission[at:end], 0.0, np.zeros(end - at)
        for bits in range(1 << (end - at)):
            y = [(bits >> i) & 1 for i in range(end - at)]
            weight = np.exp(sum(e for e, s in zip(own, y) if s) + start * y[0] + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += weight
            want += weight * np.array(y)
        assert np.allclose(got[at:end], want / total)
    assert np.isclose(pairs.sum(), 5)


def test_toxic_spans_are_offsets_of_the_text(spark, toxic_model):
    texts = [*ODD, (6, "é " * 2000 + "what an Idiot, yes"), (7, "Idiot idiot")]
    got = toxicity.tag_toxic(spark.createDataFrame(texts, SCHEMA).withColumn("spans", F.lit(1)), toxic_model).collect()
    assert [r.text[s.start : s.end] for r in got if r.doc_id == 6 for s in r.spans] == ["Idiot"]
    assert [(s.start, s.end) for r in got if r.doc_id == 7 for s in r.spans] == [(0, 11)]
    assert {r.doc_id for r in got if r.score >= 0.5} == {6, 7}
    assert all(r.spans == [] and r.toxic_words == 0 for r in got if r.doc_id not in (6, 7))
    assert toxicity.tag_toxic(spark.createDataFrame([], SCHEMA), toxic_model).count() == 0


def test_licences_on_odd_rows(spark):
    rows = [*ODD, (6, "x Under  THE-mit license, under the MIT license"), (7, "word " * 20_000 + "CC BY-NC"), (8, "Licensed under the GNU General Public License, version 3!")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit(1))).collect()}
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].labels) == (2, 1, 5, "mit")
    assert (got[7].first_word, got[7].base_labels) == (20_000, "cc-by-nc")
    assert (got[8].n_base, got[8].first_word, got[8].base_labels, got[8].labels) == (0, None, "", "gpl-3")
    assert (got[1].n_words, got[2].n_words, got[1].labels, got[1].score) == (0, 0, "", 0.0)
    assert licences.scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licence_of_a_text_that_begins_with_the_key_phrase(spark):
    heads = {"gpl-3": "GNU General Public License version 3", "cc-by-sa": "CC BY-SA 4.0", "unlicense": "unencumbered software released into the public domain"}
    rows = [(i, f"{lead}{head}") for i, (lead, head) in enumerate((lead, head) for head in heads.values() for lead in ("", "one two three "))]
    # Common lead words weigh little; a text may also end before or begin after a key phrase.
    rows += [(100 + i, "licensed under the free and") for i in range(400)] + [(50, "general public license version 3"), (51, "SA 4.0"), (52, "GNU")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, label in enumerate(heads):
        first, later = got[2 * i], got[2 * i + 1]
        assert label in first.labels.split(",") and first.labels == later.labels and first.score == later.score
        assert [p.start + 3 for p in first.places] == [p.start for p in later.places]
    assert [got[i].labels for i in (50, 51, 52, 100)] == ["", "", "", ""]


VOCABULARY = b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256))


def test_length_curve_equals_counting(spark):
    rows = [(None,), ("",), ("ab",), ("ab",), ("abc",), ("é" * 500,)]
    df = spark.createDataFrame(rows, "text string").withColumn("n_tokens", F.lit("old"))
    counted = tokens.count_tokens(df, VOCABULARY)
    lengths = sorted(r.n_tokens for r in counted.collect())
    assert lengths == [0, 0, 2, 2, 3, 1000]
    curve = tokens.length_curve(tokens.length_histogram(counted)).cache()
    for r in curve.collect():
        assert r.docs == lengths.count(r.length) and r.longer_docs == sum(n > r.length for n in lengths)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
    for limit, got in tokens.at_limits(curve, [0, 1, 2, 100, 5000]).items():
        assert got["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert got["cut_docs"] == sum(n > limit for n in lengths) and got["whole_docs"] + got["cut_docs"] == len(lengths)
    assert tokens.quantiles(curve, [0.0, 0.5, 0.6, 1.0]) == [0, 2, 2, 1000]
    assert tokens.length_curve(tokens.length_histogram(counted.limit(0))).count() == 0


def test_very_long_runs_have_their_tokens(spark):
    """Cut out runs of white space where the pattern would: the same ids as when each piece of the pattern is encoded alone."""
    own = tokens.encoder(VOCABULARY)
    for run in (" " * 1000, "\n" * 1500, " \n" * 700, "\u3000" * 1001, "\x1c" * 1200):
        for before in ("", "a", "a b", "!"):
            for after in ("", "b", " b", "\x1cb", "!"):
                text = before + run + after
                assert tokens.encoded_length(text, own) == len(own.encode_ordinary(text))
    texts = {" " * 10_000_000: 10_000_000, "ab" + " \t" * 2_000_000 + "c": 4_000_003, "x" * 100_000 + "\n" * 2_000_000: 2_100_000, "!?" * 500_000: 1_000_000}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert {r.text: r.n_tokens for r in tokens.count_tokens(df, VOCABULARY).collect()} == texts


def test_longest_common_subsequence_equals_the_table():
    random = np.random.default_rng(2)
    for _ in range(20):
        part, words = random.integers(1, 6, 64), random.integers(0, 6, 90)
        masks = np.zeros((1, 6), dtype=np.uint64)
        np.bitwise_or.at(masks[0], part, np.uint64(1) << np.arange(64, dtype=np.uint64))
        table = np.zeros((65, 91), dtype=int)
        for i in range(64):
            for j in range(90):
                table[i + 1, j + 1] = table[i, j] + 1 if part[i] == words[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.longest_common(masks, np.zeros(1, dtype=int), words[None, :])[0] == table[64, 90]


def test_leaks_are_found_anywhere_and_clean_texts_are_left(spark):
    random = np.random.default_rng(4)
    prose = [" ".join(f"p{random.integers(3000)}" for _ in range(300)) for _ in range(60)]
    items = [" ".join(f"p{random.integers(3000)}" for _ in range(n)) for n in (14, 30, 59, 150, 9)]
    docs = [(i, p) for i, p in enumerate(prose)]
    for i, item in enumerate(items[:4]):
        words = prose[i].split()
        at = 37 + 11 * i
        docs.append((100 + i, " ".join(words[:at] + [item.upper()] + words[at:])))
    edited = items[2].split()
    del edited[20], edited[40]
    docs += [(200, prose[5] + " " + " ".join(edited)), (201, None), (202, ""), (203, items[0]), (203, items[0])]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("leaks", F.lit("old"))
    # Short items count where they stand word by word.
    short = prose[9].split()[100:105]
    assert sum(" ".join(short) in p for p in prose) == 1
    docs += [(300, " ".join(short[:2] + ["p1"] + short[2:])), (301, "x " + " ".join(short).upper() + ".")]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("leaks", F.lit("old"))
    bench = [*enumerate(items), (7, None), (8, "short one"), (9, items[0]), (10, " ".join(short))]
    bench = spark.createDataFrame(bench, "item_id int, text string")
    got = decontam.find_leaks(frame, bench, dims=24).collect()
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in got if r.leaks}
    assert found == {9: {10}, 100: {0, 9}, 101: {1}, 102: {2}, 103: {3}, 200: {2}, 203: {0, 9}, 301: {10}}
    assert len(got) == len(docs)
    split = decontam.find_leaks(frame, bench, dims=24, block_items=2).collect()
    assert {r.doc_id for r in split if r.leaks} == set(found)
    assert decontam.find_leaks(frame, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontam.find_leaks(frame.limit(0), bench).count() == 0
    only = decontam.find_leaks(frame, bench.where("item_id IN (7, 8, 10)")).where("size(leaks) > 0")
    assert {r.doc_id for r in only.collect()} == {9, 301}
