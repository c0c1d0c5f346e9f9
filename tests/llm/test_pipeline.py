"""The pipeline, stage by stage: each keeps documents' columns, and its decision shows."""

from pyspark.sql import functions as F
from test_tables import SF_DIR, plain_components

import corpus_pipeline
from feedmill.llm.staging import staged
from feedmill.sources.relational import read_table


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "decontamination", "mixing"]
    docs = read_table(spark, SF_DIR, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), "test")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        assert docs.columns[: len(columns)] == columns
        if name == "near duplicates":
            assert set(after) == {i for i, (_, c) in plain_components(before, 5, 80).items() if c == i}
        elif name != "mixing":
            assert docs.columns == columns and len(after) >= 0.7 * len(before)
        before = after
    rows = docs.collect()
    assert all(0 < r.taken <= 2 * r.size for r in rows)


def test_stages_on_an_empty_table(spark):
    docs = read_table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), "empty")
        assert docs.count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (None, "", "en", None, 0), (None, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, read_table(spark, SF_DIR, "documents").schema)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()
    # Each row without words stays.
    assert sorted(str(r.doc_id) for r in got) == ["1", "None", "None"]


def test_columns_of_clashing_names_come_through(spark):
    names = ("score", "spans", "toxic_words", "leaks", "row", "digest", "doc", "of", "first", "size", "taken", "ahead", "position", "key", "cid", "_text")
    docs = read_table(spark, SF_DIR, "documents").limit(60).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), "clash")
        rows = docs.collect()
        assert len(rows) > 10
        for n in names:
            if name != "mixing" or n not in corpus_pipeline.ADDED:
                assert {r[n] for r in rows} == {f"own {n}"}
    assert all(0 < r.taken <= 2 * r["size"] for r in rows)


def unlike(i, words=12):
    return " ".join(f"d{i}w{k}" for k in range(words))


def test_unlike_rows_of_one_id_stay(spark):
    rows = [(None, unlike(i), "en", "s", 11) for i in range(4)] + [(7, unlike(i), "en", "s", 11) for i in range(4, 7)]
    # Near copies: under the same id, without an id, and of a row whose id is smaller.
    rows += [(7, unlike(4, 11), "en", "s", 11), (None, unlike(1, 11), "en", "s", 11), (3, unlike(6), "en", "s", 11)]
    docs = spark.createDataFrame(rows, read_table(spark, SF_DIR, "documents").schema)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()
    assert len(got) == 7 and {r.text.split()[0] for r in got} == {f"d{i}w0" for i in range(7)}
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in got if r.text.startswith("d6")) == [("3", "d6w0")]


def test_mix_of_repeated_ids_keeps_each_row_once(spark):
    rows = [(None, unlike(i), "en", "s", 11) for i in range(3)] + [(7, unlike(i), "en", "t", 11) for i in range(3, 6)]
    docs = spark.createDataFrame(rows, read_table(spark, SF_DIR, "documents").schema)
    got = corpus_pipeline.mix_sources(spark, docs, SF_DIR).collect()
    texts = [r.text for r in got]
    assert len(texts) == len(set(texts)) <= len(rows) and all(r.size == 12 and 0 < r.taken <= 24 for r in got)
    assert {s: sum(r.taken for r in got if r.source == s) for s in "st"} == {r.source: int(r.target) for r in got}
