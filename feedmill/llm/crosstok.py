"""Alignment of two tokenizers over a corpus, with a fast path for tokens that both have alike.

Token ends of both over the same bytes cut a text into groups. A group of one token each holds equal bytes: its pair is known from
an array that maps A's ids to B's ids of the same bytes, made once from the vocabularies, so it is only counted, in a vector
as long as A's vocabulary. Only the pairs of other groups are counted by a shuffle of pairs. The same holds on the way back:
a document's share of the fast pairs is read from vectors, and so are the most frequent other pairs, of which there is a
fixed number at most; what is left joins the pairs' table by a shuffle, where no pair is frequent any more.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.staging import staged
from feedmill.llm.text import row_runs
from feedmill.llm.tokens import PATTERN

# Bytes of texts that are worked through at a time, and pieces that a task remembers before it begins anew.
RUN_BYTES = 1 << 19
MOST_PIECES = 1 << 16
# Pairs of documents that are scored at a time.
RUN_PAIRS = 1 << 17
# Pairs besides the fast ones whose counts go to every task. It changes the work only, not the result.
FREQUENT_PAIRS = 1 << 16
# Where both tokenizers begin a new token, and what tells that some blank of a text is no such place.
CUT = re.compile(r"(?<=\S) (?=\S)")
OTHER_BLANK = re.compile(r"^ | $|\s | \s")
# Characters outside of these may be classed by other Unicode versions in the faster encoder.
UNUSUAL = re.compile(r"[^\x00-\u024f\u0384-\u0523\u2000-\u2063\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
# Characters of pieces that are encoded at a time, and of one that is encoded by itself.
JOINED_CHARS = 1 << 16
LONG_PIECE = 1 << 12
# Fixed value: the sign that stands for a blank in B's pieces.
BLANK = "▁"


class _Tokenizers(dict):
    """Tokenizers of a process by vocabulary; left behind when the function that uses them is sent to a task."""

    def __reduce__(self):
        return _Tokenizers, ()


_TOKENIZERS: dict = _Tokenizers()


@dataclass
class Vocabularies:
    """The files of both tokenizers, as bytes; they travel with the job."""

    a: bytes
    b: bytes

    def load(self):
        """A and B as this process has them."""
        name = hashlib.sha256(self.a + self.b).digest()
        if name not in _TOKENIZERS:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            import tokenizers

            first = tokenizers.Tokenizer.from_str(self.a.decode())
            first.encode_special_tokens = True
            second = sentencepiece.SentencePieceProcessor(model_proto=self.b)
            bytes_a, bytes_b = token_bytes_a(self.a), token_bytes_b(second)
            _TOKENIZERS[name] = Loaded(first, quick_encoder(self.a, bytes_a), second, bytes_a, bytes_b)
        return _TOKENIZERS[name]


@dataclass
class Loaded:
    """Both tokenizers and the bytes of their ids; ``quick`` encodes ordinary pieces as ``a`` does, or is None."""

    a: object
    quick: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]


def quick_encoder(vocabulary: bytes, token_bytes: list[bytes]):
    """A faster encoder of the same vocabulary, if its merges are in the order of their ids and it cuts texts the usual way."""
    import tiktoken

    described = json.loads(vocabulary)
    vocab, merges, cut = described["model"]["vocab"], described["model"]["merges"], described.get("pre_tokenizer") or {}
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not described.get("normalizer")
    if not usual or [vocab.get(m) for m in pairs] != list(range(256, 256 + len(pairs))):
        return None
    ranks = {token_bytes[i]: i for i in range(256 + len(pairs))}
    return tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte as one printable sign: itself where it is one, else the next sign from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes_a(vocabulary: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    described = json.loads(vocabulary)
    signs, found = byte_of_sign(), {}
    for token, i in described["model"]["vocab"].items():
        found[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    for added in described.get("added_tokens", []):
        found[added["id"]] = added["content"].encode()
    return [found.get(i, b"") for i in range(max(found) + 1)]


def token_bytes_b(pieces) -> list[bytes]:
    """Bytes of each piece: those of its text, U+2581 as a blank, or the byte it names."""
    return [
        bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace(BLANK, " ").encode()
        for i in range(pieces.get_piece_size())
    ]


def identity_map(a: list[bytes], b: list[bytes], is_byte: list[bool]) -> np.ndarray:
    """For each id of A, B's id of the same bytes, a piece rather than a named byte; -1 where B has none."""
    ids: dict[bytes, int] = {}
    for i in sorted(range(len(b)), key=lambda i: (is_byte[i], i)):
        ids.setdefault(b[i], i)
    return np.array([ids.get(t, -1) if t else -1 for t in a], dtype=np.int64)


def cut_text(text: str) -> list[str]:
    """The pieces of a text, each without the blank before it; both tokenizers encode blank and piece as within the whole."""
    return CUT.split(text) if OTHER_BLANK.search(text) else text.split(" ")


@dataclass
class Aligned:
    """Tokens of several pieces after one another, and the links between them."""

    group_a: np.ndarray  # number of each token's group over all pieces
    group_b: np.ndarray
    link_a: np.ndarray  # token of A, and of B, of each link
    link_b: np.ndarray
    alone: np.ndarray  # links of groups of one token each


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Align token lengths in bytes; both sides cover the same bytes.

    Between two neighbouring ends of either side lies one token of A and one of B, and no other stretch has the same two,
    so these stretches are the links."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=np.uint8)
    marks[ends_a] |= 1
    marks[ends_b] |= 2
    marks = marks[np.flatnonzero(marks)]
    is_a, is_b, is_both = marks & 1, marks >> 1, marks == 3
    link_a, link_b, group = ((np.cumsum(m, dtype=np.int64) - m) for m in (is_a, is_b, is_both))
    group_a, group_b = group[is_a == 1], group[is_b == 1]
    sizes = np.bincount(group_a) + np.bincount(group_b) if len(group) else np.zeros(0, np.int64)
    return Aligned(group_a, group_b, link_a, link_b, sizes[group] == 2)


class Pieces:
    """What a task knows of the distinct pieces it has met; grows by batches of new ones, until it is cleared."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.index: dict[str, int] = {}
        self.valid = none.astype(bool)
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each
        self.groups: list[str] = []
        self.fast = np.zeros(1, np.int64), none  # offsets, and A's id of each fast link
        self.slow = np.zeros(1, np.int64), none  # offsets, and a * ids_b + b of each other link

    def __len__(self) -> int:
        return len(self.groups)


def _offsets(start: int, owner: np.ndarray, n: int) -> np.ndarray:
    return start + np.cumsum(np.bincount(owner, minlength=n))


def _each(pieces: list[str], loaded: Loaded, side: str) -> list[list[int]]:
    if side == "a":
        return [found.ids for found in loaded.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
    return loaded.b.encode(pieces, num_threads=1)


def encode_pieces(pieces: list[str], loaded: Loaded, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all pieces after one another, the piece of each, and which pieces the tokenizer does not give back byte for byte.

    Pieces that begin and end with other than white space are joined by blanks and encoded together, since each begins a new
    token; the bytes of the ids tell them apart again.
    """
    table = loaded.bytes_a if side == "a" else loaded.bytes_b
    length = np.array([len(t) for t in table], dtype=np.int64)
    together, alone, at = [[]], [], 0
    unusual = side == "a" and (loaded.quick is None or UNUSUAL.search(" ".join(pieces)) is not None)
    for i, piece in enumerate(pieces):
        if len(piece) > LONG_PIECE or piece != piece.strip() or (unusual and (loaded.quick is None or UNUSUAL.search(piece))):
            alone.append(i)
            continue
        if at > JOINED_CHARS:
            together.append([])
            at = 0
        together[-1].append(i)
        at += len(piece) + 1
    ids, owners, wrong = [], [], np.zeros(len(pieces), dtype=bool)
    for own in together:
        if not own:
            continue
        joined = " ".join([pieces[i] for i in own])
        found = loaded.quick.encode_ordinary(" " + joined) if side == "a" else loaded.b.encode(joined)
        if b"".join(map(table.__getitem__, found)) != (" " + joined).encode():
            alone += own
            continue
        found = np.array(found, dtype=np.int64)
        ends = np.cumsum([len(pieces[i].encode()) + 1 for i in own])
        ids.append(found)
        owners.append(np.array(own, dtype=np.int64)[np.searchsorted(ends, np.cumsum(length[found]))])
    for i, found in zip(alone, _each([pieces[i] for i in alone], loaded, side)):
        if b"".join(map(table.__getitem__, found)) == (" " + pieces[i]).encode():
            ids.append(np.array(found, dtype=np.int64))
            owners.append(np.full(len(found), i, dtype=np.int64))
        else:
            wrong[i] = True
    none = np.zeros(0, np.int64)
    ids, owners = np.concatenate([none, *ids]), np.concatenate([none, *owners])
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order], wrong


def learn(known: Pieces, new: list[str], vocabularies: Vocabularies, same: np.ndarray) -> None:
    """Encode and align new pieces. One that either tokenizer does not give back byte for byte is not valid, and has no tokens."""
    loaded, n = vocabularies.load(), len(new)
    (a, of_a, wrong_a), (b, of_b, wrong_b) = (encode_pieces(new, loaded, side) for side in "ab")
    valid = ~(wrong_a | wrong_b)
    a, of_a, b, of_b = a[valid[of_a]], of_a[valid[of_a]], b[valid[of_b]], of_b[valid[of_b]]
    size_a, size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (loaded.bytes_a, loaded.bytes_b))
    found = align(size_a[a], size_b[b])
    link_of = of_a[found.link_a]
    pair_a, pair_b = a[found.link_a], b[found.link_b]
    fast = found.alone & (same[pair_a] == pair_b)
    of_group = of_a[np.flatnonzero(np.diff(found.group_a, prepend=-1))]
    counts = [np.bincount(owner, minlength=n) for owner in (of_a, of_b, of_group, link_of)]

    start = len(known)
    known.index.update(zip(new, range(start, start + n)))
    known.valid = np.concatenate([known.valid, valid])
    known.sizes = np.concatenate([known.sizes, np.stack(counts, axis=1)])
    known.groups += _group_texts(a, b, of_a, of_b, found, loaded, n)
    for name, chosen, values in (("fast", fast, pair_a), ("slow", ~fast, pair_a * len(size_b) + pair_b)):
        offsets, held = getattr(known, name)
        grown = _offsets(len(held), link_of[chosen], n)
        setattr(known, name, (np.concatenate([offsets, grown]), np.concatenate([held, values[chosen]])))


def _group_texts(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, found: Aligned, loaded: Loaded, n: int) -> list[str]:
    """Each piece's groups as ``a1,a2|b1;a3|b2,b3;``."""
    table = _signs(len(loaded.bytes_a), len(loaded.bytes_b))
    groups = int(found.group_a[-1]) + 1 if len(a) else 0
    in_a, in_b = (np.bincount(g, minlength=groups) for g in (found.group_a, found.group_b))
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (found.group_a, found.group_b))
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[found.group_a]] = 2 * a + last_a
    codes[np.arange(len(b)) + np.cumsum(in_a)[found.group_b]] = 2 * (b + len(loaded.bytes_a)) + last_b
    cuts = (np.searchsorted(of_a, np.arange(n + 1)) + np.searchsorted(of_b, np.arange(n + 1))).tolist()
    said = list(map(table.__getitem__, codes.tolist()))
    return ["".join(said[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]


@lru_cache(2)
def _signs(ids_a: int, ids_b: int) -> list[str]:
    """How an id is written within its group, and at its end."""
    return [f"{i}{end}" for n, ends in ((ids_a, ",|"), (ids_b, ",;")) for i in range(n) for end in ends]


def _runs(column: pa.Array, known: Pieces, vocabularies: Vocabularies, same: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: how many, the pieces of all of them as indexes, and each piece's row. Texts without tokens have none."""
    for run in row_runs(column, RUN_BYTES):
        pieces = [cut_text(t) if t else [] for t in run.to_pylist()]
        flat = list(chain.from_iterable(pieces))
        new = [p for p in dict.fromkeys(flat) if p not in known.index]
        if new:
            learn(known, new, vocabularies, same)
        index = np.fromiter(map(known.index.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        whole = np.ones(len(pieces), dtype=bool)
        whole[row[~known.valid[index]]] = False
        yield len(pieces), index[whole[row]], row[whole[row]]


def _expand(lists: tuple[np.ndarray, np.ndarray], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the pieces' lists, and for each the place of its piece in ``pieces``."""
    offsets, values = lists
    n = offsets[pieces + 1] - offsets[pieces]
    place = np.repeat(np.arange(len(pieces)), n)
    within = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return values[offsets[pieces][place] + within], place


def _row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between neighbouring cuts."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _list_of(kind: pa.ListType, offsets: np.ndarray, columns: list[np.ndarray]) -> pa.Array:
    """Lists of structs from flat columns."""
    fields = list(kind.value_type)
    items = pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items).cast(kind)


FAST = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int64())]))
SLOW = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = "fast array<struct<a:int,n:bigint>>, slow array<struct<code:bigint,n:bigint>>"
COUNTED = f"key {{}}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, {LISTS}, all_{LISTS.replace(' slow', ' all_slow')}"


def _align_batches(vocabularies: Vocabularies, same: np.ndarray, key_type: pa.DataType):
    """A row for each document with its pairs, and now and then a row with ``all_fast`` and ``all_slow``, the numbers of pairs
    so far: the fast ones from a vector by A's id."""
    told = [("groups_sha256", pa.string()), ("fast", FAST), ("slow", SLOW), ("all_fast", FAST), ("all_slow", SLOW)]
    schema = pa.schema([("key", key_type), *[(c, pa.int64()) for c in NUMBERS], *told])

    def pairs(known: Pieces, times: np.ndarray, ids_a: int) -> pa.RecordBatch:
        met = np.flatnonzero(times)
        vector = np.zeros(ids_a, dtype=np.int64)
        a, place = _expand(known.fast, met)
        np.add.at(vector, a, times[met][place])
        held = np.flatnonzero(vector)
        codes, place = _expand(known.slow, met)
        codes, at = np.unique(codes, return_inverse=True)
        slow = np.zeros(len(codes), dtype=np.int64)
        np.add.at(slow, at, times[met][place])
        lists = [_list_of(FAST, np.array([0, len(held)]), [held, vector[held]]), _list_of(SLOW, np.array([0, len(codes)]), [codes, slow])]
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(schema)[:8]], *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_a = len(vocabularies.load().bytes_a)
        known, times = Pieces(), np.zeros(0, np.int64)
        for batch in batches:
            at = 0
            for rows, index, row in _runs(batch.column(1), known, vocabularies, same):
                times = np.concatenate([times, np.zeros(len(known) - len(times), np.int64)])
                times += np.bincount(index, minlength=len(times))
                cuts = np.searchsorted(row, np.arange(rows + 1))
                total = _row_sums(known.sizes[index], cuts)
                said, ends = list(map(known.groups.__getitem__, index.tolist())), cuts.tolist()
                texts = ["".join(said[lo:hi])[:-1] for lo, hi in zip(ends[:-1], ends[1:])]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                lists = []
                for kind, of_piece in ((FAST, known.fast), (SLOW, known.slow)):
                    values, place = _expand(of_piece, index)
                    owner, values, n = _distinct(row[place], values)
                    lists.append(_list_of(kind, np.searchsorted(owner, np.arange(rows + 1)), [values, n]))
                sums = [pa.array(total[:, i]) for i in range(len(NUMBERS))]
                none = [pa.nulls(rows, FAST), pa.nulls(rows, SLOW)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *sums, pa.array(digests, pa.string()), *lists, *none], schema=schema)
                at += rows
                if len(known) > MOST_PIECES:
                    yield pairs(known, times, ids_a)
                    known.clear()
                    times = np.zeros(0, np.int64)
        yield pairs(known, times, ids_a)

    return run


@dataclass
class Known:
    """Counts that every task has: of the fast pairs by A's id, and of the frequent other pairs, sorted by ``a * ids_b + b``."""

    counts: np.ndarray
    best: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    pair_best: np.ndarray


SCORED = "key {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, count_sum bigint, n_best bigint, rest array<struct<code:bigint,n:bigint>>"


def _score_batches(known: Known, key_type: pa.DataType):
    """Sums of each document's links over the known pairs; its other pairs are passed on."""
    told = [("groups_sha256", pa.string()), ("count_sum", pa.int64()), ("n_best", pa.int64()), ("rest", SLOW)]
    schema = pa.schema([("key", key_type), *[(c, pa.int64()) for c in NUMBERS], *told])

    def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, value and number of all entries of a list column."""
        items = column.flatten()
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        return row, *(items.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in runs of rows with about so many pairs, as sums of many take several times their room."""
        ends = np.cumsum([0, *(batch.column(-2).value_lengths().to_numpy() + batch.column(-1).value_lengths().to_numpy())])
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(ends, ends[row] + RUN_PAIRS, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(runs, batches)):
            *kept, fast, slow = batch.columns
            rows = np.arange(batch.num_rows + 1)
            row, a, n = entries(fast)
            total = _row_sums(np.stack([n * known.counts[a], n * known.best[a]], axis=1), np.searchsorted(row, rows))
            row, codes, n = entries(slow)
            at = np.minimum(np.searchsorted(known.pairs, codes), max(0, len(known.pairs) - 1))
            held = known.pairs[at] == codes if len(known.pairs) else np.zeros(len(codes), bool)
            if len(known.pairs):
                count, best = known.pair_counts[at] * held, known.pair_best[at] & held
                total += _row_sums(np.stack([n * count, n * best], axis=1), np.searchsorted(row, rows))
            rest = _list_of(SLOW, np.searchsorted(row[~held], rows), [codes[~held], n[~held]])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total[:, 0]), pa.array(total[:, 1]), rest], schema=schema)

    return run


def _distinct(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, and how often each stands."""
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    first = np.flatnonzero(new)
    return owner[first], codes[first], np.diff(np.append(first, len(codes)))


def align_tokenizers(df: DataFrame, vocabularies: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A encodes a blank and the text, B the text, before which it puts a blank itself. Byte offsets at which tokens of both end
    cut them into groups; tokens whose byte ranges overlap are linked. A pair of ids counts as often as it is linked in all rows.
    ``n_best`` are the row's links whose pair counts as much as any of its B id, ``count_sum`` is the sum of its links' counts.

    NULL and empty texts, and those that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest. Texts are encoded whole, in pieces that end where both begin a new token anyway. Repeated rows
    and NULL keys are rows of their own; ties count as best; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    loaded = vocabularies.load()
    ids_a, ids_b = len(loaded.bytes_a), len(loaded.bytes_b)
    same = identity_map(loaded.bytes_a, loaded.bytes_b, [loaded.b.is_byte(i) for i in range(ids_b)])
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    source = source.select(F.struct("key", F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    key_type = spark.createDataFrame([], source.select("key").schema).toArrow().schema.field(0).type
    kind = source.schema["key"].dataType.simpleString()
    rows = staged(source.mapInArrow(_align_batches(vocabularies, same, key_type), COUNTED.format(kind)), "aligned")

    # Counts of all pairs. What reaches the driver has a row for each id of a vocabulary at most.
    fast = rows.select(F.inline("all_fast")).groupBy("a").agg(F.sum("n").alias("n"))
    fast_rows = [(a * ids_b + int(same[a]), n) for a, n in fast.collect()]
    fast_pairs = spark.createDataFrame(fast_rows, "code bigint, n bigint")
    slow_pairs = rows.select(F.inline("all_slow")).groupBy("code").agg(F.sum("n").alias("n"))
    pairs = staged(slow_pairs.union(fast_pairs).groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("code") % ids_b
    highest = spark.createDataFrame(pairs.groupBy(b.alias("b")).agg(F.max("n")).collect(), "b bigint, most bigint")
    judged = pairs.withColumn("b", b).join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))

    counts, best = np.zeros(ids_a, dtype=np.int64), np.zeros(ids_a, dtype=bool)
    for code, n, is_best in judged.join(F.broadcast(fast_pairs.select("code")), "code").collect():
        counts[code // ids_b], best[code // ids_b] = n, is_best
    # No more pairs than FREQUENT_PAIRS can have that share of all links.
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = sorted(tuple(r) for r in judged.where(F.col("n") * FREQUENT_PAIRS >= total).collect())
    kinds = (np.int64, np.int64, bool)
    known = Known(counts, best, *(np.array([row[i] for row in often], dtype=kind) for i, kind in enumerate(kinds)))

    lists = rows.where("key IS NOT NULL").select("key", *NUMBERS, "groups_sha256", "fast", "slow")
    scored = staged(lists.mapInArrow(_score_batches(known, key_type), SCORED.format(kind)), "scored")
    rest = (
        scored.select(F.col("key.row").alias("_row"), F.inline("rest").alias("_code", "_n"))
        .join(judged, F.col("_code") == F.col("code"))
        .groupBy("_row")
        .agg(F.sum(F.col("_n") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_n"))).alias("_best"))
    )
    return scored.join(rest, F.col("key.row") == F.col("_row"), "left").select(
        F.col("key.key").alias(key),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
