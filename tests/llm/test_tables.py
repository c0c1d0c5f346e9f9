"""Registered queries of the llm package against their SQL, or against plain Python where SQL cannot say it."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from check_queries import compare, connect

from feedmill.llm import chat, registry, tokens

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(sql):
    return connect(SF_DIR).sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    compare(spark, connect(SF_DIR), SF_DIR, name)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, len(registry.QUERIES) + 1))


def test_token_lengths_equal_a_recount(spark):
    own = tokens.encoder(Path(registry.VOCABULARY).read_bytes())
    lengths = Counter(len(own.encode_ordinary(text or "")) for (text,) in rows_of("SELECT text FROM documents"))
    got = {r.length: r for r in registry.QUERIES["op1_token_lengths"](spark, SF_DIR).collect()}
    assert {n: r.docs for n, r in got.items()} == lengths
    for n, r in got.items():
        assert r.longer_docs == sum(k for m, k in lengths.items() if m > n) and r.longer_tokens == sum(m * k for m, k in lengths.items() if m > n)
        assert r.truncated_total == sum(min(m, n) * k for m, k in lengths.items())


def test_licence_places_equal_a_plain_search(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op4_licence_scan"](spark, SF_DIR).collect()}
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for doc_id, text in rows_of("SELECT doc_id, text FROM documents"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places = [(k, l) for l, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r, starts = got[doc_id], [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
        )
        assert r.base_labels == ",".join(sorted({l for _, l in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_chat_digests_equal_the_turns(spark):
    got = {r.conv_id: r for r in registry.QUERIES["op3_prefix_target_chat"](spark, SF_DIR).collect()}
    turns = defaultdict(list, {-1: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]})
    for conv, role, text in rows_of("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn"):
        turns[conv].append((role, text or ""))
    assert set(got) == set(turns)
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        # Every example is written out whole: its context is all turns before it.
        pieces = [(r, re.sub(chat.ESCAPE, r"\1\\\2\3", t)) for r, t in own]
        pieces = [(r, f"{chat.OPEN}{r}\n{t}{chat.CLOSE}", t) for r, t in pieces]
        assert got[conv].formatted_chars == sum(len(p) for _, p, _ in pieces)
        told, chars = hashlib.sha256(), 0
        for i, (role, piece, text) in enumerate(pieces):
            if role == "assistant":
                context = "".join(p for _, p, _ in pieces[:i])
                digest = hashlib.sha256(context.encode()).hexdigest()
                told.update(f"{len(context)} {digest} {len(context + piece)} {text}\n".encode())
                chars += len(context + piece)
        assert (got[conv].n_examples, got[conv].examples_chars) == (sum(r == "assistant" for r, _ in own), chars)
        assert got[conv].examples_sha256 == told.hexdigest()


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_leaks_equal_a_plain_search(spark):
    """Every item that stands in a text is found, and what is found has most of an item in the order of its words."""
    items = {i: words_of(t) for i, t in rows_of("SELECT item_id, text FROM benchmark")}
    docs = {i: words_of(t) for i, t in rows_of("SELECT doc_id, text FROM documents")}
    got = {(r.doc_id, r.item_id): r for r in registry.QUERIES["op10_latent_decontamination"](spark, SF_DIR).collect()}
    joined = {d: " ".join(w) for d, w in docs.items()}
    whole = {(d, i) for i, item in items.items() for d, text in joined.items() if f" {' '.join(item)} " in f" {text} "}
    assert whole and whole <= set(got)
    for (d, i), r in got.items():
        near = docs[d][max(0, r.start - 32) : r.start + len(items[i]) + 64]
        assert common_length(items[i], near) >= 0.6 * min(len(items[i]), 64)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain_components(texts, n, percent):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets, root = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components_equal_all_pairs(spark):
    got = registry.QUERIES["op7_ngram_jaccard"](spark, SF_DIR).collect()
    want = plain_components(dict(rows_of("SELECT doc_id, text FROM documents")), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_embeddings", "quality", 0.85), ("op5_toxic_spans", "toxic", 0.85)])
def test_classifiers_on_held_out_documents(spark, name, label, least):
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = connect("/root/testdata/sf0.01").sql(f"SELECT doc_id, {label} FROM labels").fetchall()
    held = [got[i].predicted == y for i, y in labels if i in got and got[i].held_out]
    assert len(held) > 50 and sum(held) / len(held) >= least
