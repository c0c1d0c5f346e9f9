"""Tokenizer alignment against a plain alignment by byte offsets."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedmill.llm import crosstok, registry

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def vocabularies():
    return crosstok.Vocabularies(*(Path(f).read_bytes() for f in registry.TOKENIZERS))


def spans(ids, table):
    found, at = [], 0
    for i in ids:
        found.append((at, at + len(table[i]), i))
        at += len(table[i])
    return found


def plain(texts, vocabularies):
    """For each text the query's columns, by comparing all byte ranges."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_str(vocabularies.a.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
    of_a, of_b = crosstok.token_bytes_a(vocabularies.a), crosstok.token_bytes_b(b)
    docs = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(of_a[i] for i in ids[0]) != whole or b"".join(of_b[i] for i in ids[1]) != whole:
            ids = ([], [])
        sides = spans(ids[0], of_a), spans(ids[1], of_b)
        ends = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
        groups, links, at = [], [], [0, 0]
        for end in ends:
            own = []
            for k, side in enumerate(sides):
                part = []
                while at[k] < len(side) and side[at[k]][1] <= end:
                    part.append(side[at[k]])
                    at[k] += 1
                own.append(part)
            groups.append("|".join(",".join(str(i) for _, _, i in part) for part in own))
            links += [(x, y) for s, e, x in own[0] for t, f, y in own[1] if max(s, t) < min(e, f)]
        docs.append((len(ids[0]), len(ids[1]), groups, links))
    counts = Counter(link for _, _, _, links in docs for link in links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            n_a,
            n_b,
            len(groups),
            len(links),
            sum(counts[x, y] == most[y] for x, y in links),
            sum(counts[link] for link in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in docs
    ]


def aligned(spark, texts, vocabularies):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in crosstok.align_tokenizers(df, vocabularies).collect()}
    return [got[i] for i in range(len(texts))]


ODD = [
    None,
    "",
    " ",
    "   three  blanks \n\n and\tlines\r\n",
    "a</s>b<s> <|endoftext|><unk> [INST]",
    "aaaaaaaaaaaaaaaaa aa a aaaa",
    "naïve café — “quotes” 你好世界 😀👩‍👩‍👧 ﬁne é",
    "▁ the sign ▁▁ itself",
    "nul \x00 and ​   blanks",
    "the same words",
    "the same words",
    "12345 1,000.50 don't we'll",
]


def test_against_a_plain_alignment(spark, vocabularies, monkeypatch):
    rng = np.random.default_rng(2)
    words = "the of tokenization Überfluss 漢字 naïve x y zz antidisestablishmentarianism ﬁ 😀 -- ... 3.14".split()
    texts = ODD + [" ".join(rng.choice(words, 40)) for _ in range(30)]
    want = plain(texts, vocabularies)
    assert aligned(spark, texts, vocabularies) == want
    assert want[0] == want[1] == (0, 0, 0, 0, 0, 0, "") and want[9] == want[10]
    # No pair is known to every task.
    monkeypatch.setattr(crosstok, "FREQUENT_PAIRS", 0)
    assert aligned(spark, texts, vocabularies) == want


def test_texts_are_cut_where_nothing_changes(spark, vocabularies, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.select("text").orderBy("doc_id").limit(60).collect()] + ODD
    want = plain(texts, vocabularies)
    monkeypatch.setattr(crosstok, "MOST_PIECES", 20)
    monkeypatch.setattr(crosstok, "RUN_BYTES", 5000)
    assert aligned(spark, texts, vocabularies) == want


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" * 1_000_000, "!?" * 500_000, "word " * 400_000, "漢" * 300_000, "\n" * 1_000_000], ids=lambda t: repr(t[:2]))
def test_very_long_texts(spark, vocabularies, text):
    (got,) = aligned(spark, [text], vocabularies)
    assert got[0] > 0 and got[3] >= max(got[:2]) and got[2] > 0 and len(got[6]) == 64


def test_a_text_that_most_rows_have_and_repeated_rows(spark, vocabularies):
    texts = ["the very same long text 漢字"] * 200 + ["another naïve text"] * 3
    assert aligned(spark, texts, vocabularies) == plain(texts, vocabularies)


def test_null_keys_clashing_columns_and_empty_tables(spark, vocabularies):
    df = spark.createDataFrame([(None, "some naïve text"), (None, "other text"), (1, None)], "doc_id long, text string")
    for name in ("n_a", "key", "row", "a", "b", "n", "fast", "rest"):
        df = df.withColumn(name, F.lit("mine"))
    got = crosstok.align_tokenizers(df, vocabularies).collect()
    want = plain(["some naïve text", "other text", None], vocabularies)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(want)
    assert crosstok.align_tokenizers(df.limit(0), vocabularies).count() == 0


def test_the_query_equals_a_plain_alignment(spark, vocabularies):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows], vocabularies)))
    got = registry.QUERIES["op11_tokenizer_alignment"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_the_identity_map_prefers_pieces(vocabularies):
    loaded = vocabularies.load()
    b, of_a, of_b = loaded.b, loaded.bytes_a, loaded.bytes_b
    same = crosstok.identity_map(of_a, of_b, [b.is_byte(i) for i in range(len(of_b))])
    held = np.flatnonzero(same >= 0)
    assert loaded.quick is not None
    assert len(held) > 10_000 and all(of_a[i] == of_b[same[i]] for i in held)
    assert b.id_to_piece(int(same[of_a.index(b"A")])) == "A"


def test_room_of_scores():
    # Many documents in one batch: what is summed at a time is a run of them, and the sums are those of each row by itself.
    rng, rows, n = np.random.default_rng(5), 6000, 250
    offsets = np.arange(rows + 1) * n
    fast = crosstok._list_of(crosstok.FAST, offsets, [rng.integers(0, 900, rows * n), rng.integers(1, 9, rows * n)])
    slow = crosstok._list_of(crosstok.SLOW, offsets // 5, [rng.integers(0, 99, rows * n // 5), rng.integers(1, 9, rows * n // 5)])
    numbers = [pa.array(np.full(rows, 3)) for _ in crosstok.NUMBERS]
    columns = [pa.array(np.arange(rows)), *numbers, pa.array(["x"] * rows), fast, slow]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", *crosstok.NUMBERS, "groups_sha256", "fast", "slow"])
    pairs = np.arange(0, 99, 2)
    known = crosstok.Known(rng.integers(0, 50, 900), rng.random(900) < 0.5, pairs, pairs + 7, pairs % 4 == 0)
    score = crosstok._score_batches(known, pa.int64())
    tracemalloc.start()
    got, most = [], 0
    for part in score(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        got.append(part)
    tracemalloc.stop()
    assert most < 40e6
    got = pa.Table.from_batches(got).to_pylist()
    assert [r["key"] for r in got] == list(range(rows))
    for i in (0, 1, 2999, rows - 1):
        own, left = batch.slice(i, 1).to_pylist()[0], got[i]
        held = [p for p in own["slow"] if p["code"] % 2 == 0]
        assert left["count_sum"] == sum(p["n"] * int(known.counts[p["a"]]) for p in own["fast"]) + sum(p["n"] * (p["code"] + 7) for p in held)
        assert left["n_best"] == sum(p["n"] for p in own["fast"] if known.best[p["a"]]) + sum(p["n"] for p in held if p["code"] % 4 == 0)
        assert left["rest"] == [p for p in own["slow"] if p["code"] % 2]


def test_room_of_pieces(vocabularies, monkeypatch):
    # Texts of ever new words: what a task remembers is bounded, and so are the new ones of a run.
    most, learn = [0], crosstok.learn
    monkeypatch.setattr(crosstok, "learn", lambda known, *a: (learn(known, *a), most.append(len(known))))
    texts = [" ".join(f"{i:x}z{k}" for k in range(i, i + 4000)) for i in range(0, 200_000, 4000)]
    loaded = vocabularies.load()
    same = crosstok.identity_map(loaded.bytes_a, loaded.bytes_b, [loaded.b.is_byte(i) for i in range(len(loaded.bytes_b))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    got = pa.Table.from_batches(crosstok._align_batches(vocabularies, same, pa.int64())(iter([batch]))).to_pylist()
    assert sum(r["key"] is not None for r in got) == len(texts) and sum(r["n_links"] or 0 for r in got) > 200_000
    links = Counter()
    for r in got:
        links["rows"] += r["n_links"] or 0
        links["pairs"] += sum(p["n"] for side in ("all_fast", "all_slow") for p in r[side] or [])
    assert links["rows"] == links["pairs"] and max(most) < 150_000
