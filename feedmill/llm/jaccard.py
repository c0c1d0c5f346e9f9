"""Exact Jaccard join of documents on word n-grams, by a token-group matrix.

1. A document is the set of hashes of its word n-grams; equal sets are one class, and one document of each stands for it.
2. Tokens have one order: by hash, but those last that many documents share. Two sets that link must share tokens among
   the first of each (the prefix principle), at least as many as the shorter of their prefixes is longer than it need be.
   Sets that share enough tokens that are not frequent are paired by them; groups by min-hash keep alike sets together.
3. Frequent tokens count only for the few dense sets that have hardly any other, such as a large family of near copies. A dense set
   of which too few tokens are in any other dense set links with none of them. Each of the rest is compared with one set, the hub
   of its tokens, which is the set with most tokens in common with others; those that link with it are one group and need no
   comparison among themselves, however many they are.
4. The matrix of tokens and groups holds each group's token union. A set that is not yet in a group's component is bounded by its
   overlap with the union, counting a token of its own group only if another member has it, too.
5. Groups that qualify are opened: a task gets the group's texts and those of the sets that ask, and compares exact counts.
6. Links become connected components.

A class is known by a 64-bit sum of mixed hashes; two unequal sets share it with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.components import connected_components
from feedmill.llm.staging import scratch, staged
from feedmill.llm.text import LOWER, SPACES, Hashes, mix, row_runs, slices, words_of

# A token in the prefixes of more classes than this is frequent. It changes the work only, not the result.
FREQUENT = 32
# Tokens put last in the order are those that this share of the documents of some batch have, the most frequent first, and
# no more of them than go to every task. Any choice gives the same result.
COMMON_SHARE = 0.002
COMMON_MOST = 50_000
# N-grams in a group before it is cut into blocks.
BLOCK_TOKENS = 100_000
# Columns of a comparison's token table at a time.
CHUNK = 4096


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its n-word shingles (A-Z lower-cased, ASCII white space);
    of fewer words, one hash of all; without words, none."""
    hashes: list[list] = [[] for _ in range(len(column))]
    for part in slices(column):
        words = words_of(part, ~SPACES)
        own = mix(Hashes(LOWER[part.data]).span(words.start, words.end))
        cuts = np.searchsorted(words.row, np.arange(len(part.rows) + 1))
        for i, row in enumerate(part.rows):
            hashes[row].append(own[cuts[i] : cuts[i + 1]])
    for parts in hashes:
        words = parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint64)])
        k = min(n, len(words))
        if not k:
            yield words
            continue
        total = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            total = mix(total) + words[i : len(words) - k + 1 + i]
        yield np.unique(mix(total))


def common_tokens(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the shingles that many documents share, counted over all of them.

    A shingle that a share of all documents has, has it in some batch as well, so tasks pass on only those.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in (list(shingle_sets(own, n)) for batch in batches for own in row_runs(batch.column(0))):
            own, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            some = np.flatnonzero(counts >= max(8, COMMON_SHARE * len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(own[some].astype(np.int64)), pa.array(counts[some])], names=["token", "docs"])

    counted = texts.mapInArrow(count, "token bigint, docs bigint").groupBy("token").agg(F.sum("docs").alias("docs"))
    most = counted.orderBy(F.desc("docs"), "token").limit(COMMON_MOST).select("token").toArrow().column(0)
    return np.sort(most.to_numpy().astype(np.uint64))


def in_order(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set in token order: those in ``common`` last."""
    if not len(common):
        return tokens
    place = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    last = common[place] == tokens
    return np.concatenate([tokens[~last], tokens[last]])


def class_of(tokens: np.ndarray) -> int:
    return int(np.sum(mix(tokens ^ np.uint64(0xA5A5)), dtype=np.uint64).astype(np.int64))


def _sketch(n: int, percent: int, key_type: pa.DataType, common: np.ndarray) -> Callable:
    """Per document: class, set size, min-hash, the start of its token order, and the text. The last two are given once per
    class and task, so many copies of one text do not multiply them."""
    schema = pa.schema(
        [("key", key_type), ("cid", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("tokens", pa.list_(pa.int64())), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for column in row_runs(batch.column(1)):
                yield sketched(batch.column(0).slice(at, len(column)), column, seen)
                at += len(column)

    def sketched(keys: pa.Array, column: pa.Array, seen: set[int]) -> pa.RecordBatch:
        cids, sizes, lows, tokens, places = [], [], [], [], []
        for row, own in enumerate(shingle_sets(column, n)):
            sizes.append(len(own))
            places.append(None)
            if not len(own):
                cids.append(None)
                lows.append(None)
                tokens.append(None)
                continue
            cid = class_of(own)
            cids.append(cid)
            lows.append(int(np.min(mix(own ^ np.uint64(0x5A5A))).astype(np.int64)))
            tokens.append(None)
            if cid not in seen:
                tokens[-1], places[-1] = in_order(own, common)[: stored(len(own), percent)].astype(np.int64), row
                seen.add(cid)
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(cids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(lows, pa.int64()),
                pa.array(tokens, pa.list_(pa.int64())),
                column.take(pa.array(places, pa.int64())).cast(pa.string()),
            ],
            schema=schema,
        )

    return run


def needed(n: int, percent: int) -> int:
    """Length of the prefix in which sets that link must share a token."""
    return n - ceil(percent * n / 100) + 1


def stored(n: int, percent: int) -> int:
    """Tokens kept of a set: its prefix, a quarter more, and eight."""
    p = needed(n, percent)
    return min(n, p + ceil(p / 4) + 8)


def _shingles_of(n: int) -> Callable:
    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int64())
        runs = [pa.array([s.astype(np.int64) for s in shingle_sets(own, n)], kind) for own in row_runs(texts)]
        return pa.concat_arrays([*runs, pa.array([], kind)])

    return shingles


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of 0/1 tables over a few thousand tokens at a time.

    Tokens that one side alone has are left out first."""
    own = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    common = np.intersect1d(*own)
    counts = np.zeros((len(left), len(right)), dtype=np.float64)
    tables = []
    for side, tokens in zip((left, right), own):
        doc = np.repeat(np.arange(len(side)), [len(s) for s in side])
        place = np.searchsorted(common, tokens)
        held = place < len(common)
        held[held] = common[place[held]] == tokens[held]
        order = np.argsort(place[held], kind="stable")
        tables.append((doc[held][order], place[held][order]))
    for at in range(0, len(common), CHUNK):
        dense = []
        for side, (doc, place) in zip((left, right), tables):
            lo, hi = np.searchsorted(place, [at, at + CHUNK])
            table = np.zeros((len(side), min(CHUNK, len(common) - at)), dtype=np.float32)
            table[doc[lo:hi], place[lo:hi] - at] = 1
            dense.append(table)
        counts += dense[0] @ dense[1].T
    return counts.astype(np.int64)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of sets that link. Only sets of which enough lies in the other side's token union are compared."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    passing = []
    for side, other, size in ((left, right, sizes[0]), (right, left, sizes[1])):
        union = np.unique(np.concatenate(other))
        bound = np.array([np.isin(s, union, assume_unique=True).sum() for s in side])
        passing.append(np.flatnonzero(100 * bound >= percent * size))
    common = overlaps([left[i] for i in passing[0]], [right[i] for i in passing[1]])
    union = sizes[0][passing[0]][:, None] + sizes[1][passing[1]][None, :] - common
    a, b = np.nonzero(100 * common >= percent * union)
    return passing[0][a], passing[1][b]


def _open(n: int, percent: int) -> Callable:
    """Compare the members of two groups (or of one with itself) and link them, one link per member fewer than joined."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cid = table.column("cid").to_numpy()
        same = table.column("ga")[0] == table.column("gb")[0]
        first = np.asarray(table.column("g").to_numpy() == table.column("ga").to_numpy())
        sets = list(shingle_sets(table.column("text").combine_chunks(), n))
        members = [np.flatnonzero(first), np.flatnonzero(first if same else ~first)]
        root = np.arange(len(cid))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for at in range(0, len(members[0]), 256):
            for to in range(at if same else 0, len(members[1]), 256):
                side = [members[0][at : at + 256], members[1][to : to + 256]]
                a, b = linked_pairs(*[[sets[i] for i in s] for s in side], percent)
                for i, j in zip(side[0][a], side[1][b]):
                    if (x := find(i)) != (y := find(j)):
                        root[max(x, y)] = min(x, y)
                        links.append((cid[i], cid[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def jaccard_classes(
    df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", hot: int = FREQUENT
) -> DataFrame:
    """One row per document: key, ``n_shingles`` (set size), and ``component_id``, the smallest key reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of n-word shingles. NULL, empty and blank
    texts have empty sets, link with nothing and are their own component. Repeated rows stay, each with its component; a
    NULL key takes part and is never a component's id unless it has no other. Other columns are ignored. What is staged on the way
    is dropped; the result is a table of its own.
    """
    with scratch(df.sparkSession):
        return staged(_joined(df, n, percent, key, text, hot), "jaccard", keep=True)


def _joined(df: DataFrame, n: int, percent: int, key: str, text: str, hot: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = spark.createDataFrame([], docs.select("key").schema).toArrow().schema.field(0).type
    kind = docs.schema["key"].dataType.simpleString()
    sketch = _sketch(n, percent, key_type, common_tokens(docs.select("text"), n))
    sketched = staged(docs.mapInArrow(sketch, f"key {kind}, cid bigint, n bigint, low bigint, tokens array<bigint>, text string"), "sketch")
    texts = sketched.where("text IS NOT NULL AND cid IS NOT NULL").select("cid", "text")
    groups = staged(_groups(sketched, percent), "groups")

    # Token order: classes per token, over all stored tokens.
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = F.least(F.col("n"), need + F.ceil(need / 4) + 8)
    places = sketched.where("tokens IS NOT NULL").select("cid", "n", F.explode("tokens").alias("token"))
    shared = staged(
        places.repartition("token")
        .groupBy("token", "cid")
        .agg(F.first("n").alias("n"))
        .withColumn("df", F.count(F.lit(1)).over(W.partitionBy("token")))
        .where("df > 1"),
        "tokens",
    )
    frequent = shared.where(F.col("df") > hot).groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("hot"))
    # Of the tokens stored of a set, how many that are not frequent any partner must have; below 1 the set is dense.
    spare = staged(frequent.select(F.col("cid").alias("_cid"), (kept - F.col("hot") - need + 1).alias("_least")), "spare")

    def with_least(tokens: DataFrame) -> DataFrame:
        joined = tokens.join(spare, F.col("cid") == F.col("_cid"), "left")
        return joined.withColumn("least", F.coalesce("_least", kept - need + 1)).where("least >= 1").drop("_cid", "_least")

    # Sparse sets with each other.
    cold = staged(with_least(shared.where(F.col("df") <= hot)).select("token", "cid", "n", "least"), "cold")
    pairs = (
        cold.alias("x")
        .join(cold.alias("y"), F.expr(f"x.token = y.token AND x.cid < y.cid AND 100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n"))
        .groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        .agg(F.count(F.lit(1)).alias("both"), F.min(F.least("x.least", "y.least")).alias("least"))
        .where("both >= least")
        .select("a", "b")
    )
    of_a, of_b = (groups.select(F.col("cid").alias(c), F.col("g").alias(f"g_{c}")) for c in "ab")
    pairs = staged(pairs.join(of_a, "a").join(of_b, "b"), "pairs")
    ends = (F.least("g_a", "g_b").alias("ga"), F.greatest("g_a", "g_b").alias("gb"))
    touched = pairs.select(*ends, F.col("a").alias("cid"), F.col("g_a").alias("g")).union(
        pairs.select(*ends, F.col("b").alias("cid"), F.col("g_b").alias("g"))
    )

    # Dense sets: with each other, and sparse sets with them.
    dense = groups.join(spare.where("_least < 1"), F.col("cid") == F.col("_cid")).select("cid", "n", "g")
    sets = texts.join(dense.hint("merge"), "cid").dropDuplicates(["cid"])
    sets = staged(sets.select("cid", "n", "g", _shingles_of(n)("text").alias("tokens")), "dense")
    matrix, members, links, asked = _dense_groups(sets, percent)
    rare = places.join(shared.where(F.col("df") > hot).select("token").distinct(), "token", "left_anti")
    band = _band(percent)
    with_dense = (
        rare.join(matrix.select("token", F.col("g").alias("g_b"), F.col("band").alias("band_b")), "token")
        .where(F.abs(F.col("band_b") - band) <= 2)
        .select("token", "cid", "n", "g_b")
        .distinct()
    )
    with_dense = (
        with_least(with_dense)
        .groupBy("cid", "g_b")
        .agg(F.count(F.lit(1)).alias("both"), F.first("least").alias("least"))
        .where("both >= least")
        .join(groups.select("cid", F.col("g").alias("g_a")), "cid")
        .select(F.col("g_a").alias("ga"), F.col("g_b").alias("gb"), "cid", F.col("g_a").alias("g"))
    )
    asked = staged(asked.union(with_dense), "asked")
    side = asked.select("ga", "gb").distinct().join(members, F.col("gb") == F.col("g")).select("ga", "gb", "cid", "g")
    opened = staged(touched.union(asked).union(side).distinct(), "opened")

    # Open: each pair of groups in one task, with the texts of its touched members.
    wanted = staged(opened.select("cid").distinct(), "wanted")
    # Texts are shuffled at any size, so that the plan does not change with it.
    texts = texts.join(wanted.hint("merge"), "cid").dropDuplicates(["cid"])
    found = opened.join(texts, "cid").groupBy("ga", "gb").applyInArrow(_open(n, percent), "a bigint, b bigint")

    # Components of classes, then each document's.
    rooted = connected_components(links.union(found))
    reps = groups.select("cid", "rep")
    named = reps.join(rooted.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    component = staged(named.join(lowest, "root").select(F.col("cid").alias("_cid"), "component"), "components")
    return sketched.join(component, F.col("cid") == F.col("_cid"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id")
    )


def _band(percent: int) -> Column:
    """Band of a set size ``n``. Sets that link are at most one band apart; one more is allowed for rounding."""
    return F.floor(F.log("n") / np.log(100 / min(percent, 99))).cast("int")


def _groups(sketched: DataFrame, percent: int) -> DataFrame:
    """Per class: smallest key, size, and group by min-hash and size band, large ones in blocks."""
    classes = sketched.where("n > 0").groupBy("cid").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"))
    banded = classes.withColumn("band", _band(percent))
    sizes = banded.groupBy("low", "band").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_TOKENS)
    cut = sizes.select(F.col("low").alias("_low"), F.col("band").alias("_band"), F.ceil(F.col("total") / BLOCK_TOKENS).alias("blocks"))
    block = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1)))
    return banded.join(staged(cut, "blocks"), (F.col("low") == F.col("_low")) & (F.col("band") == F.col("_band")), "left").select(
        "cid", "rep", "n", F.xxhash64("low", "band", block).alias("g")
    )


def _dense_groups(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups of dense sets (cid, n, g, tokens), what links within them, and which sets must be compared with which groups.

    Returns the matrix (token, g, band), the members (cid, g), links (a, b), and asking sets as (ga, gb, cid, g): ``cid`` of group
    ``ga`` is to be compared with all members of ``gb``.
    """
    tokens = sets.select("cid", "n", F.explode("tokens").alias("token"))
    # Sets of which enough tokens are in another one.
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    shared = staged(tokens.join(often, "token"), "dense-tokens")
    held = shared.groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("held")).where(F.col("held") * 100 >= F.col("n") * percent)
    held = staged(held.select(F.col("cid").alias("_cid"), "held"), "held")
    near = shared.join(held, F.col("cid") == F.col("_cid")).select("cid", "n", "token", "held")

    # The hub of a token, of a set the one that most of its tokens have; and the overlap of each set with its hub.
    best = F.max(F.struct((F.col("held") / F.col("n")).alias("share"), F.col("cid").alias("hub"))).alias("best")
    hubs = near.groupBy("token").agg(best).select(F.col("token").alias("_token"), "best.hub")
    votes = near.join(hubs, F.col("token") == F.col("_token")).groupBy("cid", "hub").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("votes"))
    chosen = staged(votes.groupBy("cid").agg(F.first("n").alias("n"), F.max_by("hub", F.struct("votes", "hub")).alias("hub")), "hubs")
    mine = near.select("cid", "token").join(chosen.select(F.col("cid").alias("_of"), "hub"), F.col("cid") == F.col("_of"))
    of_hubs = near.join(chosen.select(F.col("hub").alias("_hub")).distinct(), F.col("cid") == F.col("_hub"))
    of_hubs = of_hubs.select("_hub", F.col("token").alias("_token"), F.col("n").alias("_n"))
    both = mine.join(of_hubs, (F.col("hub") == F.col("_hub")) & (F.col("token") == F.col("_token"))).groupBy("cid").agg(
        F.count(F.lit(1)).alias("both"), F.first("_n").alias("hub_n")
    )
    both = both.select(F.col("cid").alias("_of"), "both", "hub_n")
    # Tokens that no other dense set has are no one's overlap, but they count in the sizes.
    linked = F.coalesce(F.col("both") * 100 >= (F.col("n") + F.col("hub_n") - F.col("both")) * percent, F.lit(False)) | (F.col("cid") == F.col("hub"))
    cores = staged(chosen.join(both, F.col("cid") == F.col("_of"), "left").select("cid", "hub", linked.alias("core")), "cores")
    links = cores.where("core AND cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))

    # Groups of all dense sets, with bands of sizes, in blocks: linked with a hub, near it, or apart from all others.
    placed = sets.select("cid", "n", "g").join(cores.withColumnRenamed("cid", "_of"), F.col("cid") == F.col("_of"), "left")
    placed = placed.withColumn("band", _band(percent)).withColumn("family", F.coalesce("hub", "g"))
    total = placed.groupBy("family", "core", "band").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    total = total.select(*[F.col(c).alias(f"_{c}") for c in ("family", "core", "band")], "blocks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("family", "core", "band")]
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    members = placed.join(total, same).select("cid", "n", "hub", "core", "band", F.xxhash64("family", "core", "band", block).alias("g"))
    members = staged(members, "dense-members")
    of_member = members.select(F.col("cid").alias("_cid"), "hub", "core", "band", "g")
    matrix = tokens.join(of_member, F.col("cid") == F.col("_cid")).groupBy("token", "g").agg(
        F.count(F.lit(1)).alias("holders"), *[F.first(c).alias(c) for c in ("band", "hub", "core")]
    )
    matrix = staged(matrix, "matrix")

    # Sets against groups that are not of their component: those not linked with a hub ask all, the others the linked groups
    # of other hubs. Of two groups on a par one asks the other.
    asking = near.select("cid", "n", "token").join(of_member, F.col("cid") == F.col("_cid")).select("cid", "n", "token", "hub", "core", "band", "g")
    union = matrix.where("core IS NOT NULL")
    allowed = F.expr(
        "x.token = y.token AND abs(x.band - y.band) <= 2 AND (x.g <> y.g OR y.holders > 1) AND"
        " ((NOT x.core AND (y.core OR x.g <= y.g)) OR (x.core AND y.core AND x.hub <> y.hub AND x.g < y.g))"
    )
    bounds = asking.alias("x").join(union.alias("y"), allowed).groupBy(
        F.col("x.cid").alias("cid"), F.col("x.n").alias("n"), F.col("x.g").alias("ga"), F.col("y.g").alias("gb")
    ).agg(F.count(F.lit(1)).alias("both"))
    smallest = members.groupBy("g").agg(F.min("n").alias("smallest"))
    # J >= p% asks for an overlap of p / (100 + p) of both sizes together.
    least = F.greatest(F.col("n") * percent * (100 + percent), (F.col("n") + F.col("smallest")) * percent * 100)
    asked = bounds.join(smallest, F.col("gb") == F.col("g")).where(F.col("both") * 100 * (100 + percent) >= least)
    return matrix, members.select("cid", "g"), links, asked.select("ga", "gb", "cid", F.col("ga").alias("g"))
