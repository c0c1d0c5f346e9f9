"""Benchmark decontamination by latent semantic retrieval.

1. Words that occur in the benchmark become numbers, all others 0. The documents' numbers are staged; the statistics are
   taken from them instead of the texts.
2. A passage is a window of words. IDF comes from segments of all documents; a passage's weights are its words' IDF.
3. A randomised SVD of all passages: each task multiplies its passages with random directions and back, the tasks'
   products are summed by word, and the driver, which holds only (benchmark words x directions) numbers, orthonormalises
   the sum. A second such pass gives the singular values.
4. Windows of every document whose latent cosine with a benchmark item reaches a threshold are candidates.
5. A candidate counts if the longest common subsequence of words covers enough of the item, or a good part of it while
   the answer's words are there as well.
6. Items too short for a passage of their own are looked for word by word, as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmill.llm.staging import staged
from feedmill.llm.text import LOWER, Hashes, mix, row_runs, slices, words_of
from feedmill.llm.toxicity import LETTERS

# Words in a block. Windows begin at every block and have as many blocks as an item part fills, two at least, so one of
# them holds most of it wherever it stands; what is verified has a block more on each side.
BLOCK = 16
# Words of a text worked at a time, and blocks that a window reaches beyond.
PIECE = BLOCK * 8192
BEYOND = 5
PORTION = 60_000
# Items are compared in parts of this many words: the bits of a machine word.
PART = 64
MATCH = "array<struct<item:int,start:bigint,cosine:double,lcs:double,answered:boolean>>"


@dataclass(frozen=True)
class Benchmark:
    """Parts of items as word numbers (from 1, 0 is every other word); ``hashes`` are the words' hashes in order."""

    item_ids: list
    of: np.ndarray  # the item each part belongs to
    parts: list[np.ndarray]
    answers: list[np.ndarray]
    hashes: np.ndarray
    short: list[tuple[int, np.ndarray]]  # items of few words, whole


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word of letters and digits, A-Z lower-cased, slice by slice."""
    for part in slices(column):
        words = words_of(part, LETTERS)
        yield part.rows[words.row], mix(Hashes(LOWER[part.data]).span(words.start, words.end))


def hashes_by_row(column: pa.Array) -> list[np.ndarray]:
    found: list[list] = [[] for _ in range(len(column))]
    for row, own in word_hashes(column):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for i, hashes in zip(row[np.append(0, cuts)] if len(row) else [], np.split(own, cuts)):
            found[i].append(hashes)
    return [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]


def read_benchmark(items: pa.Table, least_words: int, answer_words: int, exact_words: int) -> Benchmark:
    """Items (id, text, and an optional answer text) with at least ``least_words`` words, and short ones of ``exact_words`` and
    more. Without an answer, an item's longest words stand for it, as its rarest."""
    ids, texts = items.column(0).to_pylist(), items.column(1).combine_chunks()
    hashes = hashes_by_row(texts)
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    given = hashes_by_row(items.column(2).combine_chunks()) if items.num_columns > 2 else [np.zeros(0, np.uint64)] * len(ids)
    lengths = {}
    for part in slices(texts):
        words = words_of(part, LETTERS)
        own = mix(Hashes(LOWER[part.data]).span(words.start, words.end))
        lengths |= dict(zip(own.tolist(), (words.end - words.start).tolist()))
    of, parts, answers, short = [], [], [], []
    for i, own in enumerate(hashes):
        if len(own) < least_words:
            short += [(i, np.searchsorted(vocabulary, own) + 1)] if len(own) >= exact_words else []
            continue
        longest = sorted(set(own.tolist()), key=lambda h: (-lengths[h], h))[:answer_words]
        answer = np.array(longest, dtype=np.uint64) if not len(given[i]) else np.unique(given[i])
        cuts = max(1, -(-len(own) // PART))
        for piece in np.array_split(own, cuts):
            of.append(i)
            parts.append(np.searchsorted(vocabulary, piece) + 1)
            # Long items are asked for the answer's words of the part at hand.
            near = np.intersect1d(answer, piece) if cuts > 1 else np.intersect1d(answer, vocabulary)
            answers.append(np.searchsorted(vocabulary, near) + 1)
    return Benchmark(ids, np.array(of, dtype=np.int64), parts, answers, vocabulary, short)


def short_matches(short: list[tuple[int, np.ndarray]], text: np.ndarray) -> list[dict]:
    """The first place of each short item whose words all stand in the text, one after the other."""
    found = []
    for n in sorted({len(words) for _, words in short}):
        if n > len(text):
            break
        runs = np.lib.stride_tricks.sliding_window_view(text, n)
        own = [(i, words) for i, words in short if len(words) == n]
        begins = np.flatnonzero(np.isin(runs[:, 0], [words[0] for _, words in own]))
        for i, words in own:
            at = begins[(runs[begins] == words).all(axis=1)]
            if len(at):
                found.append({"item": i, "start": int(at[0]), "cosine": 1.0, "lcs": 1.0, "answered": True})
    return found


def numbers_by_row(column: pa.Array, hashes: np.ndarray) -> list[np.ndarray]:
    found: list[list] = [[] for _ in range(len(column))]
    for row, own in word_hashes(column):
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        number = np.where(hashes[place] == own, place + 1, 0).astype(np.int32)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for i, part in zip(row[np.append(0, cuts)] if len(row) else [], np.split(number, cuts)):
            found[i].append(part)
    return [np.concatenate(f) if len(f) != 1 else f[0] for f in (f or [np.zeros(0, np.int32)] for f in found)]


@dataclass
class Portion:
    """Blocks of some texts, with empty blocks after each so that no window crosses over."""

    numbers: np.ndarray  # blocks x BLOCK
    row: np.ndarray  # of each block
    first: np.ndarray  # place of the block's first word in its text
    own: np.ndarray  # whether windows begin here; else the block pads, or repeats the next piece's begin


def portions(texts: list[np.ndarray]) -> Iterator[Portion]:
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def portion() -> Portion:
        blocks = [-(-len(words) // BLOCK) + BEYOND for _, _, words in parts]
        numbers = np.zeros((sum(blocks), BLOCK), dtype=np.int32)
        flat, at = numbers.ravel(), 0
        own = np.zeros(sum(blocks), dtype=bool)
        for (_, _, words), n in zip(parts, blocks):
            flat[at * BLOCK : at * BLOCK + len(words)] = words
            own[at : at + min(n - BEYOND, PIECE // BLOCK)] = True
            at += n
        starts = np.cumsum([0, *blocks[:-1]])
        place = np.arange(sum(blocks)) - np.repeat(starts, blocks)
        return Portion(
            numbers,
            np.repeat([row for row, _, _ in parts], blocks),
            np.repeat([first for _, first, _ in parts], blocks) + place * BLOCK,
            own,
        )

    for row, words in enumerate(texts):
        for first in range(0, len(words), PIECE):
            parts.append((row, first, words[first : first + PIECE + BEYOND * BLOCK]))
            held += len(parts[-1][2])
            if held >= PORTION:
                yield portion()
                parts, held = [], 0
    if parts:
        yield portion()


def block_sums(numbers: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows of each block's words."""
    out = np.empty((len(numbers), *table.shape[1:]), dtype=table.dtype)
    for at in range(0, len(numbers), 512):
        out[at : at + 512] = table[numbers[at : at + 512]].sum(axis=1)
    return out


def window_sums(sums: np.ndarray, blocks: int) -> np.ndarray:
    """Sum over each block and those after it; windows that would leave the portion are short."""
    padded = np.concatenate([sums, np.zeros((blocks - 1, *sums.shape[1:]), dtype=sums.dtype)])
    total = padded[: len(sums)].copy()
    for i in range(1, blocks):
        total += padded[i : len(sums) + i]
    return total


def stored_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield [np.frombuffer(b.as_py() or b"", dtype=np.int32) for b in batch.column(0).slice(at, 1000)]


def stored_runs(column: pa.Array, size: int = 1 << 22) -> Iterator[list[np.ndarray]]:
    """The texts of a column of stored numbers, in runs of a few megabytes."""
    texts, held = [], 0
    for value in column:
        texts.append(np.frombuffer(value.as_py() or b"", dtype=np.int32))
        held += texts[-1].nbytes
        if held >= size:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def inverse_frequencies(numbers: DataFrame, words: int) -> np.ndarray:
    """IDF of each word number over segments of 64 words of all texts; 0 for number 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(words + 1, dtype=np.int64)
        for texts in stored_texts(batches):
            for part in portions(texts):
                own = part.numbers * part.own[:, None]
                own = np.sort(np.pad(own, ((0, -len(own) % 4), (0, 0))).reshape(-1, 4 * BLOCK), axis=1)
                fresh = np.ones(own.shape, dtype=bool)
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                found += np.bincount(own[fresh], minlength=words + 1)
                found[0] += len(own) - np.count_nonzero(own[:, 0] == 0)  # at number 0: all segments
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["word", "n"])

    counted = numbers.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(words + 1)
    for row in counted:
        n[row["word"]] = row["n"]
    idf = np.log((1 + n[0]) / (1 + n)) + 0.1
    idf[0] = 0
    return idf


def apply_gram(numbers: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A'A times ``directions`` for the matrix A of all long windows: rows of IDF weights, scaled by their root of squares.

    Each task sums over its passages; the sums are added by word in Spark and are all that reaches the driver."""
    words, k = len(idf) - 1, directions.shape[1]
    weighted = (idf[:, None] * directions).astype(np.float32)
    squares = (idf * idf).astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words + 1, k))
        for texts in stored_texts(batches):
            for part in portions(texts):
                at = np.flatnonzero(part.own & (part.first % (2 * BLOCK) == 0))
                norms = window_sums(block_sums(part.numbers, squares), 4)
                along = window_sums(block_sums(part.numbers, weighted), 4)
                back = np.zeros_like(along)
                back[at] = along[at] / np.maximum(norms[at], 1e-6)[:, None]
                # A block's words get the shares of the windows that cover it.
                shares = back.copy()
                for i in range(1, 4):
                    shares[i:] += back[:-i]
                flat = part.numbers.ravel()
                used = np.flatnonzero(flat)
                flat, block = flat[used], used // BLOCK
                for j in range(k):
                    total[:, j] += np.bincount(flat, weights=shares[block, j], minlength=words + 1)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *[pa.array(total[some, j]) for j in range(k)]], names=["word", *[f"z{j}" for j in range(k)]]
        )

    schema = "word bigint, " + ", ".join(f"z{j} double" for j in range(k))
    summed = numbers.mapInArrow(multiply, schema).groupBy("word").agg(*[F.sum(f"z{j}").alias(f"z{j}") for j in range(k)])
    rows = summed.toArrow()
    out = np.zeros((words + 1, k))
    if rows.num_rows:
        out[rows.column("word").to_numpy()] = np.stack([rows.column(f"z{j}").to_numpy() for j in range(k)], axis=1)
    return out * idf[:, None]


def latent_space(numbers: DataFrame, idf: np.ndarray, dims: int, spare: int = 8) -> np.ndarray:
    """Weights (word x dim) that map a passage's words into the latent space, each direction scaled to equal spread."""
    k = min(dims + spare, max(1, len(idf) - 1))
    start = np.random.default_rng(11).standard_normal((len(idf), k))
    basis, _ = np.linalg.qr(apply_gram(numbers, idf, start))
    values, turn = np.linalg.eigh(basis.T @ apply_gram(numbers, idf, basis))
    best = np.argsort(-values)[:dims]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-12)]
    if not len(best):  # no passage shares a word with the benchmark
        return np.zeros((len(idf), 1), np.float32)
    return (idf[:, None] * (basis @ turn[:, best]) / np.sqrt(values[best])).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def longest_common(masks: np.ndarray, part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``words`` with its item part, all rows at once.

    ``masks[part, word]`` has a bit for each place of the word in the part; a row's state has a 0 bit for each
    step of the subsequence so far."""
    state = np.full(len(words), ~np.uint64(0))
    for t in range(words.shape[1]):
        hit = masks[part, words[:, t]]
        low = state & hit
        state = (state + low) | (state & ~hit)
    return np.bitwise_count(~state).astype(np.int64)


@dataclass(frozen=True)
class Retriever:
    bench: Benchmark
    space: np.ndarray
    least_cosine: float
    least_lcs: float
    answered_lcs: float

    def __post_init__(self):
        masks = np.zeros((len(self.bench.parts), len(self.bench.hashes) + 1), dtype=np.uint64)
        for i, part in enumerate(self.bench.parts):
            np.bitwise_or.at(masks[i], part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        masks[:, 0] = 0
        sizes = np.array([len(p) for p in self.bench.parts])
        vectors = unit(np.stack([self.space[p].sum(axis=0) for p in self.bench.parts]))
        for name, value in (("masks", masks), ("sizes", sizes), ("vectors", vectors)):
            object.__setattr__(self, name, value)

    def candidates(self, part: Portion) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(block, item part, cosine) of windows near an item part, and the window's blocks."""
        sums = block_sums(part.numbers, self.space)
        at = np.flatnonzero(part.own)
        blocks = np.maximum(-(-self.sizes // BLOCK), 2)
        for n in np.unique(blocks):
            items = np.flatnonzero(blocks == n)
            near = unit(window_sums(sums, n)[at])
            target = self.vectors[items].T.copy()
            for lo in range(0, len(at), 8192):
                cosine = near[lo : lo + 8192] @ target
                window, item = np.nonzero(cosine >= self.least_cosine)
                yield at[lo + window], items[item], cosine[window, item], int(n)

    def matches(self, texts: list[np.ndarray]) -> list[list[dict]]:
        """Per text, given as word numbers, the best match with each item that counts as a leak."""
        best: list[dict] = [{} for _ in texts]
        for part in portions(texts):
            for block, item, cosine, blocks in self.candidates(part):
                for lo in range(0, len(block), 20_000):
                    self._verify(texts, part, block[lo : lo + 20_000], item[lo : lo + 20_000], cosine[lo : lo + 20_000], blocks, best)
        return [sorted(b.values(), key=lambda m: m["item"]) for b in best]

    def _verify(self, texts, part, block, item, cosine, blocks, best) -> None:
        # The window and a block on each side, within its text's blocks.
        reach = np.arange(-1, blocks + 1)
        near = np.clip(block[:, None] + reach, 0, len(part.numbers) - 1)
        inside = part.row[near] == part.row[block][:, None]
        words = np.where(inside[:, :, None], part.numbers[near], 0).reshape(len(block), -1)
        lcs = longest_common(self.masks, item, words) / self.sizes[item]
        for i in np.flatnonzero(lcs >= self.answered_lcs):
            answered = bool(np.isin(self.bench.answers[item[i]], words[i]).all())
            if lcs[i] < self.least_lcs and not answered:
                continue
            number, row = int(self.bench.of[item[i]]), int(part.row[block[i]])
            found = {
                "item": number,
                "start": int(part.first[block[i]]),
                "cosine": float(cosine[i]),
                "lcs": float(lcs[i]),
                "answered": answered,
            }
            held = best[row].get(number)
            if held is None or (found["lcs"], -found["start"]) > (held["lcs"], -held["start"]):
                best[row][number] = found


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    answer: str | None = None,
    dims: int = 64,
    least_cosine: float = 0.4,
    least_lcs: float = 0.8,
    answered_lcs: float = 0.6,
    least_words: int = 8,
    exact_words: int = 4,
    block_items: int = 2000,
) -> DataFrame:
    """Add ``leaks``, an array of (item_id, start, cosine, lcs, answered), to each row of ``df``, replacing such a column.

    Whole texts are searched, row by row, without a shuffle; ``start`` is the window's first word. The benchmark is worked in blocks of
    about ``block_items`` items, so what tasks hold is bounded; each block reads the documents anew. Items
    of fewer than ``least_words`` words count where all their words stand one after the other; those of fewer than
    ``exact_words`` are phrases rather than passages and are not looked for. NULL and empty texts, and an empty benchmark, give empty
    arrays; repeated rows stay; equal items match alike.
    """
    kept = [c for c in df.columns if c != "leaks"]
    columns = [F.col(item_key), F.coalesce(F.col(item_text), F.lit("")).alias("_text")]
    columns += [F.coalesce(F.col(answer), F.lit("")).alias("_answer")] if answer else []
    id_type = benchmark.schema[item_key].dataType.simpleString()
    out = f"array<struct<item_id:{id_type},start:bigint,cosine:double,lcs:double,answered:boolean>>"
    result = df.select(*kept, F.array().cast(out).alias("leaks"))
    count = benchmark.count()
    blocks = -(-count // block_items)
    for number in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == number).select(*columns)
        bench = read_benchmark(own.orderBy(item_key, "_text").toArrow(), least_words, 3, exact_words)
        if not bench.parts and not bench.short:
            continue
        # A copy with the words as numbers: the texts are split once, and all later steps read the numbers.
        rows = result.select(F.struct(*[F.col(f"`{c}`") for c in result.columns]).alias("row"), numbered_words(bench.hashes)(F.col(text)).alias("numbers"))
        rows = staged(rows, "numbers")
        found = _search(rows.select("numbers"), bench, dims, least_cosine, least_lcs, answered_lcs)
        ids = F.array(*[F.lit(i).cast(id_type) for i in bench.item_ids])
        named = F.transform(
            found("numbers"),
            lambda m: F.struct(
                F.get(ids, m["item"]).alias("item_id"), m["start"].alias("start"), m["cosine"].alias("cosine"), m["lcs"].alias("lcs"), m["answered"].alias("answered")
            ),
        )
        result = rows.select(*[F.col(f"row.`{c}`") for c in kept], F.concat("row.leaks", named).alias("leaks"))
    return result


def numbered_words(hashes: np.ndarray) -> Callable:
    @F.arrow_udf("binary")
    def numbered(texts: pa.Array) -> pa.Array:
        runs = [pa.array([n.tobytes() for n in numbers_by_row(own, hashes)], pa.binary()) for own in row_runs(texts)]
        return pa.concat_arrays([*runs, pa.array([], pa.binary())])

    return numbered


def _search(numbers: DataFrame, bench: Benchmark, dims: int, least_cosine: float, least_lcs: float, answered_lcs: float) -> Callable:
    retriever = None
    if bench.parts:
        idf = inverse_frequencies(numbers, len(bench.hashes))
        retriever = Retriever(bench, latent_space(numbers, idf, dims), least_cosine, least_lcs, answered_lcs)

    def search(texts: list[np.ndarray]) -> list[list[dict]]:
        found = retriever.matches(texts) if retriever else [[] for _ in texts]
        if bench.short:
            found = [own + short_matches(bench.short, text) for own, text in zip(found, texts)]
        return found

    @F.arrow_udf(MATCH)
    def leaks(numbers: pa.Array) -> pa.Array:
        kind = pa.list_(
            pa.struct([("item", pa.int32()), ("start", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answered", pa.bool_())])
        )
        return pa.array([found for texts in stored_runs(numbers) for found in search(texts)], kind)

    return leaks
