"""Joins, search, mixing, chat and URLs on odd rows: NULL, empty, very long, ties, repeated, clashing columns, no rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_tables import plain_components

from feedmill.llm import ann, chat, components, jaccard, mixing, running, urls

DOCS = "doc_id long, text string, source string"


def test_running_totals_equal_a_plain_sum(spark):
    rows = [(i, [None, "a", "b", "a"][i % 4], i % 7 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v long").withColumn("_x", F.lit(1))
    got = {r.id: (r.before, r._x) for r in running.running_totals(df, {"before": "v"}, ("id",), ("g",)).collect()}
    for i, g, _ in rows:
        assert got[i] == (sum(v or 0 for j, h, v in rows if h == g and j < i), 1)
    assert running.running_totals(df.limit(0), {"before": "v"}, ("id",)).count() == 0


def mixed(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("old")).withColumn("before", F.lit(1))
    return mixing.mix(df)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(200)] + [(900, "w " * 500, "s1"), (None, "a b", None), (None, "a b", None)]
    rows += [(901, None, "s0"), (902, "", "s9")]
    draws = mixed(spark, rows)
    got = mixing.taken_per_document(draws).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        assert sum(r.taken for r in got if r.source == source) == int(target)
    stream = sorted((r for r in draws.collect() if r.taken), key=lambda r: r.position)
    assert [r.finish for r in stream] == sorted(r.finish for r in stream)
    assert [r.position for r in stream] == [sum(x.taken for x in stream[:i]) for i in range(len(stream))]
    assert sorted(map(str, mixing.taken_per_document(mixed(spark, rows)).collect())) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [r.taken for r in mixed(spark, [(1, None, "a"), (1, "", None)]).collect()] == [0, 0]


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    # a and the NULL source stop at 20 and 80; of the 2975 left, b's share by 2 and 1 is under its 2000.
    assert got["a"] == 20 and got[None] == 80
    assert got["b"] == pytest.approx(2975 * 2 / 3) and got["c"] == pytest.approx(2975 / 3)


@pytest.mark.parametrize("hot", [2, 32])
def test_jaccard_with_families_of_copies(spark, hot):
    chance = random.Random(hot)
    rows, page = [], "shared passage of words that many of the documents have in common with each other today".split()
    for family in range(4):
        base = [f"f{family}w{chance.randrange(90)}" for _ in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(chance.randrange(5)):
                own[chance.randrange(len(own))] = f"x{chance.randrange(10_000)}"
            rows.append(own + page)
    rows += [[f"u{chance.randrange(10_000)}" for _ in range(chance.randrange(1, 30))] + page for _ in range(40)]
    rows += [["one"], ["One"], ["one", "two"], page, page, [], ["a"] * 500, ["a"] * 400]
    texts = {i: " ".join(w) for i, w in enumerate(rows)} | {900: None, 901: "  \n "}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], DOCS).withColumn("cid", F.lit("old"))
    for n, percent in ((3, 90), (5, 80), (2, 100)):
        got = jaccard.jaccard_classes(df, n, percent, hot=hot).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(texts, n, percent)


def test_jaccard_of_null_keys_and_repeats(spark):
    rows = [(3, "a b c d", "s"), (3, "a b c d", "s"), (None, "a b c d", "s"), (None, "other text", "s"), (None, None, "s")]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, DOCS), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 1, "None"), ("None", 2, "3"),
    ]
    assert jaccard.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("hot", [2, 32])
def test_jaccard_of_near_copies_under_shared_keys(spark, hot):
    chance = random.Random(hot)
    rows = []
    for family in range(8):
        base = [f"f{family}w{k}" for k in range(40)]
        for copy in range(8):
            own = [*base, f"x{chance.randrange(10_000)}"] if copy else base
            rows.append(((None, 5, 6, 100 + len(rows))[chance.randrange(4)], " ".join(own)))
    rows += [(None, "unlike " + " ".join(f"u{i}w{k}" for k in range(20))) for i in range(20)]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], DOCS)
    for n, percent in ((3, 90), (5, 80)):
        got = jaccard.jaccard_classes(df, n, percent, hot=hot).collect()
        plain = plain_components({i: t for i, (_, t) in enumerate(rows)}, n, percent)
        keys: dict = {}
        for i, (_, root) in plain.items():
            keys.setdefault(root, []).append(rows[i][0])
        least = {root: min((k for k in own if k is not None), default=None) for root, own in keys.items()}
        want = [(rows[i][0], size, least[root]) for i, (size, root) in plain.items()]
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(120)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(121)} | {200: 200, 201: 200}


def plain_nearest(rows, step, k=5):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in good}
    return {q: sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q)[:k] for q in unit if q % step == 0}


def test_search_with_copies_and_unusable_vectors(spark):
    chance = np.random.default_rng(1)
    centres = chance.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + chance.normal(size=16) * 0.4).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    bad = [(2000, None), (2002, [0.0] * 16), (2004, [1.0, None] + [0.0] * 14), (2006, [float("nan")] * 16), (2008, [float("inf")] + [1.0] * 15)]
    bad += [(2010, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame([*rows, *bad, rows[5]], "vec_id long, embedding array<double>").withColumn("score", F.lit("old"))
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, part_size=40, probes=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_nearest(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in [i for _, i, _ in own]
        hits += len({i for _, i, _ in own} & {i for _, i in near})
    assert hits / (5 * len(want)) >= 0.9
    assert [i for _, i, _ in sorted(got[1000])] == [0, 1001, 1002, 1003, 1004]


def test_search_among_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(few, F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(few.where("vec_id = 0"), F.lit(True)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<[|\\/s>INST]im_endarto", max_size=40))
def test_escaping_is_reversible(text):
    import re

    escaped = re.sub(chat.ESCAPE, r"\1\\\2\3", text)
    assert chat.unescape(escaped) == text
    assert chat.CLOSE.strip() not in escaped and chat.OPEN not in escaped


def test_chat_examples_and_their_masks(spark):
    control = "</s>[INST] <|im_end|>\n<\\|im_end|> [/INST]\\ é"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", control), (1, 2, "assistant", control), (1, 3, "user", None), (1, 4, "assistant", "")]
    rows += [(1, 5, "assistant", "é!"), (2, 0, "user", "only"), (None, 0, None, "x"), (None, None, "assistant", "y"), (3, 0, "a\n\\n<s>", "z")]
    rows += [(4, 0, "assistant", "tie"), (4, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("old"))
    turns = chat.format_turns(df)
    rendered = {(r.conv_id, r.number): r for r in chat.render(turns).collect()}
    assert sorted((str(c), n) for c, n in rendered) == [("1", 2), ("1", 4), ("1", 5), ("4", 0), ("4", 1), ("None", 1)]
    for (conv, number), text in {(1, 2): control, (1, 4): "", (1, 5): "é!", (4, 1): "tie", (None, 1): "y"}.items():
        r = rendered[conv, number]
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == text
        assert r.text.count(chat.OPEN) == number + 1 and r.text.endswith(chat.CLOSE)
    assert rendered[1, 5].text.startswith(rendered[1, 2].text)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].loss_chars) == (6, len(control) + 2, 0, 1)
    import hashlib

    assert got[3].turns_sha256 == hashlib.sha256("a\n\\n<s>\nz\n".encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_a_conversation_cut_over_partitions(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 13)) for i in range(400)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turns.sort(key=lambda r: r.number)
    assert [r.number for r in turns] == list(range(400))
    assert [r.start for r in turns] == [sum(x.chars for x in turns[:i]) for i in range(400)]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://A.Example.NET/en/x?q=/de/": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://www.example.com/de/#x": ("www.example.com", "/de/", "example.com/de/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net?a=/": ("x.net", "", None, "allow"),
        "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "://net/\nline": ("net", "/\nline", "net/", "block"),
        "http://" + "a." * 3000 + "net/" + "p" * 5000: ("a." * 3000 + "net", "/" + "p" * 5000, "net/", "block"),
        "http://" + "a." * 100_000 + "example.net/en/": ("a." * 100_000 + "example.net", "/en/", "example.net/en/", "allow"),
        "http://" + "." * 50_000 + "org/fr/": ("." * 50_000 + "org", "/fr/", "org/fr/", "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(0, None), (2, list(cases)[2])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0)).withColumn("key", F.lit("old"))
    got = urls.judge_urls(df, urls.rule_table(spark, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert {r.verdict for r in urls.judge_urls(df, urls.rule_table(spark, []), default="block").collect()} == {"block"}
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, RULES)).count() == 0


def test_bloom_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = -(-2000 // urls.KEYS_PER_BLOCK)
    bloom = urls.bloom_blocks(keys, blocks)
    asked = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id")
    hit = F.lit(True)
    for i, mask in enumerate(urls._masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    passed = asked.join(bloom, urls._block(F.col("key"), blocks) == F.col("block")).where(hit)
    assert passed.where("id < 2000").count() == 2000
    assert passed.where("id >= 2000").count() < 400
