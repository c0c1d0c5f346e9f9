"""Approximate nearest neighbours by learned partitions.

1. Equal vectors become one class that keeps its smallest ids, so a vector that many rows share is compared once.
2. On a bounded sample, the graph of each vector's nearest neighbours is cut into parts of equal size with few edges between.
3. A small neural network learns, from the vector, in which parts its neighbours lie.
4. Every class goes to its most probable part; a query goes to its several most probable parts and is compared with
   all their members in double precision. Large parts are worked in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.staging import staged

# Members of a part, and queries routed to it, that meet in one task.
BLOCK = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, through their largest component, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Each row's k most similar other rows."""
    k = min(k, len(vectors) - 1)
    found = np.empty((len(vectors), k), dtype=np.int64)
    for at in range(0, len(vectors), 1024):
        cosine = vectors[at : at + 1024] @ vectors.T
        cosine[np.arange(len(cosine)), np.arange(at, at + len(cosine))] = -2
        found[at : at + 1024] = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k else 0
    return found


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 0.1) -> np.ndarray:
    """Cut the graph into parts of nearly equal size with few edges between.

    Starts from halving along the direction of largest spread, then moves vertices to the part of most of their neighbours
    (in both directions) while it has room.
    """
    part = np.zeros(len(vectors), dtype=np.int64)
    pieces = [np.arange(len(vectors))]
    while len(pieces) < parts:
        pieces.sort(key=len)
        own = pieces.pop()
        centred = vectors[own] - vectors[own].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = own[np.argsort(centred @ direction, kind="stable")]
        pieces += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, own in enumerate(pieces):
        part[own] = i
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()], 1)])
    edges = np.concatenate([edges, edges[:, ::-1]])
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    cuts = np.searchsorted(edges[:, 0], np.arange(len(vectors) + 1))
    size = np.bincount(part, minlength=parts)
    most = int(np.ceil(len(vectors) / parts * (1 + slack)))
    random = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0
        for v in random.permutation(len(vectors)):
            votes = np.bincount(part[edges[cuts[v] : cuts[v + 1], 1]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[v])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[v]]:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < len(vectors) // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer from unit vectors to parts."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.out_bias)

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(vectors @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias


def train_router(vectors: np.ndarray, targets: np.ndarray, width: int = 128, epochs: int = 30, rate: float = 2e-3) -> Router:
    """Fit by mini-batch gradient steps (Adam) to ``targets``, the share of each vector's neighbours in each part."""
    random = np.random.default_rng(3)
    dim, parts = vectors.shape[1], targets.shape[1]
    weights = [
        random.standard_normal((dim, width)) * np.sqrt(2 / dim),
        np.zeros(width),
        random.standard_normal((width, parts)) * np.sqrt(1 / width),
        np.zeros(parts),
    ]
    scaled = vectors * np.sqrt(dim)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = random.permutation(len(vectors))
        for at in range(0, len(order), 128):
            own = order[at : at + 128]
            x = scaled[own]
            h = np.maximum(x @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - targets[own]) / len(own)
            back = (error @ weights[2].T) * (h > 0)
            step += 1
            for i, gradient in enumerate((x.T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * gradient
                second[i] = 0.999 * second[i] + 0.001 * gradient * gradient
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(weights[0] * np.sqrt(dim), *weights[1:])


def learn_parts(vectors: np.ndarray, parts: int, neighbours: int = 10) -> Router:
    vectors = unit(vectors)
    graph = neighbour_graph(vectors, neighbours)
    part = balanced_parts(vectors, graph, parts)
    targets = np.zeros((len(vectors), parts))
    np.add.at(targets, (np.arange(len(vectors)), part), 1.0)
    for column in graph.T:
        np.add.at(targets, (np.arange(len(vectors)), part[column]), 1.0)
    return train_router(vectors, targets / targets.sum(axis=1, keepdims=True))


def choose_probes(router: Router, fitted: np.ndarray, held: np.ndarray, k: int, recall: float) -> int:
    """In how many parts a query must look so that ``recall`` of its k nearest among the fitted vectors lie there, on average
    over ``held`` vectors, none of which was fitted. Of the whole table the nearest are nearer still, and fewer parts would do."""
    fitted, held = unit(fitted), unit(held)
    k = min(k, len(fitted))
    part = router.logits(fitted).argmax(axis=1)
    order = np.argsort(-router.logits(held), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    found = np.zeros(router.parts)
    for at in range(0, len(held), 512):
        near = np.argpartition(-(held[at : at + 512] @ fitted.T), k - 1, axis=1)[:, :k]
        found += np.bincount(np.take_along_axis(rank[at : at + 512], part[near], axis=1).ravel(), minlength=router.parts)
    shares = np.cumsum(found) / max(1, k * len(held))
    return int(np.searchsorted(shares, recall - 1e-9)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vector: Column) -> Column:
    """Not NULL or zero, every component there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(keep: int) -> Callable:
    """Each query's ``keep`` nearest ids in a block. Products choose a few more, whose cosines are then summed in one
    order everywhere, so that equal vectors score equally in every block."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and members.num_rows:
            theirs = unit(_matrix(members.column("vector")))
            ids = members.column("ids").combine_chunks().to_pylist()
            own, names = unit(_matrix(queries.column("vector"))), queries.column("cid").to_numpy()
            few = min(2 * keep + 8, len(theirs))
            for at in range(0, len(own), 256):
                rough = own[at : at + 256] @ theirs.T
                # Ties at the edge stay in: everything within rounding of the last one is kept.
                edge = -np.partition(-rough, few - 1, axis=1)[:, few - 1] - 1e-12
                for i, row in enumerate(rough):
                    near = np.flatnonzero(row >= edge[i])
                    exact = (theirs[near] * own[at + i]).sum(axis=1)
                    best = [(-float(s), x) for s, j in zip(exact, near) for x in ids[j]]
                    best.sort()
                    best = best[:keep]
                    out.append((np.full(len(best), names[at + i]), np.array([x for _, x in best]), np.array([-s for s, _ in best])))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"cid": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": columns[2]})

    return run


def _lookup(queries: DataFrame, members: DataFrame, keep: int) -> DataFrame:
    """Compare ``queries`` (part, cid, vector) with ``members`` (part, cid, vector, ids) of the same part."""
    sizes = members.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    cuts = staged(sizes.join(asked, "part"), "cuts")  # one row per part
    left = (
        queries.join(F.broadcast(cuts), "part")
        .withColumn("chunk", F.pmod("cid", "chunks"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    right = (
        members.join(F.broadcast(cuts), "part")
        .withColumn("block", F.pmod("cid", "blocks"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    )
    keys = ("part", "block", "chunk")
    return (
        left.select(*keys, "cid", "vector")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "vector", "ids").groupBy(*keys))
        .applyInArrow(_search(keep), "cid bigint, vec_id bigint, score double")
    )


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    sample: int = 8192,
    part_size: int = 400,
    max_parts: int = 64,
    probes: int | None = None,
    recall: float = 0.95,
    held: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row ``is_query`` selects, by cosine.

    The index is fitted on at most ``sample`` distinct vectors, chosen by hash, and holds all rows. It has one part per
    ``part_size`` of the sample, ``max_parts`` at most; a query looks in ``probes`` of them, and if these hold fewer than k
    others, in all. Unless it is given, the number of probes is what ``held`` more vectors, which are not fitted, need for
    a share of ``recall`` of their nearest among the fitted ones; so it is few where vectors are clustered and most of the
    parts where they have no order. Ties go to the smaller id. Vectors that are NULL, zero, hold NULL or
    non-finite components, or have another length than most, take no part, nor do rows with a NULL id. Repeated rows
    count once; rows of one id with different vectors are all candidates, but never for their own id.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"), is_query.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("vector") == lengths[0]["n"]).withColumn("cid", F.xxhash64("vector"))

    # Classes of equal vectors with their k + 1 smallest ids: a query needs k besides its own.
    first = W.partitionBy("cid").orderBy("vec_id")
    few = rows.groupBy("cid", "vec_id").agg(F.first("vector").alias("vector")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = staged(few.groupBy("cid").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = staged(rows.where("asked").select(F.col("vec_id").alias("query_id"), "cid").distinct(), "asked")
    drawn = _matrix(classes.orderBy("cid").limit(sample + held).select("vector").toArrow().column(0))
    # The class's hash is no order of the vectors, so any run of them is a fair sample.
    apart = min(held, len(drawn) // 10)
    fitted, tested = drawn[: len(drawn) - apart][:sample], drawn[len(drawn) - apart :]
    parts = int(min(max_parts, max(1, len(fitted) // part_size)))
    router = learn_parts(fitted, parts) if parts > 1 else None
    if probes is None:
        probes = choose_probes(router, fitted, tested, k, recall) if router and len(tested) else parts

    def routed(count: int) -> Callable:
        @F.arrow_udf("array<int>")
        def route(vectors: pa.Array) -> pa.Array:
            if router is None or not len(vectors):
                return pa.array([[0]] * len(vectors), pa.list_(pa.int32()))
            logits = router.logits(unit(_matrix(vectors)))
            best = np.argsort(-logits, axis=1, kind="stable")[:, :count].astype(np.int32)
            return pa.array(list(best), pa.list_(pa.int32()))

        return route

    members = staged(classes.withColumn("part", F.get(routed(1)("vector"), F.lit(0))), "members")
    queries = classes.join(asked.select("cid").distinct(), "cid").select("cid", "vector")
    probed = staged(queries.withColumn("part", F.explode(routed(probes)("vector"))), "probed")
    found = staged(_best(asked, _lookup(probed, members, k + 1), k), "found")
    counts = asked.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = staged(counts.where(F.coalesce("n", F.lit(0)) < k).select("query_id", "cid"), "short")
    if short.isEmpty() or probes >= parts:
        return found
    whole = queries.join(short.select("cid").distinct(), "cid").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return found.join(short.select("query_id"), "query_id", "left_anti").union(_best(short, _lookup(whole, members, k + 1), k))


def _best(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best of what was found for each query's class, without the query itself."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    others = asked.join(found, "cid").where(F.col("query_id") != F.col("vec_id"))
    ranked = others.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
