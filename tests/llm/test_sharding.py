"""Histogram sort: shards of near equal bytes, against a plain sort of the same order."""

import zlib

import pytest
from pyspark.sql import functions as F

from feedmill.llm import registry, sharding


def check(spark, df, shards=24, tolerance=0.01, per_shard=3):
    """Sizes, crc and gapless slots of all rows; byte shares; and shards that follow the order of the hashes."""
    got = sharding.shard_by_bytes(df, shards, tolerance, per_shard).toPandas()
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    size = {i: len((r.text or "").encode()) + 8 for i, r in enumerate(rows)}
    assert sorted(got["size"]) == sorted(size.values())
    assert sorted(got.text_crc32) == sorted(zlib.crc32((r.text or "").encode()) for r in rows)
    total, largest = sum(size.values()), max(size.values(), default=0)
    by_shard = got.groupby("shard")
    for shard, own in by_shard:
        assert 0 <= shard < shards and sorted(own.slot) == list(range(len(own)))
    sizes = by_shard["size"].sum().to_dict()
    below = 0
    for shard in range(shards - 1):
        below += sizes.get(shard, 0)
        assert abs(below - total * (shard + 1) / shards) <= max(tolerance * total / shards, largest / 2) + 1
    order = sharding.sized(df).select(F.col("doc.doc_id").alias("doc_id"), "text_crc32", "size", "k1", "k2").orderBy("k1", "k2").toPandas()
    placed = got.sort_values(["shard", "slot"])
    assert list(placed.text_crc32) == list(order.text_crc32) and list(placed["size"]) == list(order["size"])
    return got


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_sizes_and_slots(spark):
    got = check(spark, frame(spark, [(i, "é" * (i % 50) + f" text {i}") for i in range(3000)]))
    assert got.shard.nunique() == 24


def test_a_text_with_most_rows_is_cut_and_others_stay_together(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i // 9}") for i in range(3000)]
    got = check(spark, frame(spark, rows))
    texts = got.groupby("text").shard.nunique()
    assert texts["the same text"] > 12 and texts.drop("the same text").max() <= 2


def test_equal_rows_are_cut_by_their_place(spark):
    got = check(spark, frame(spark, [(7, "copy")] * 500 + [(None, "copy")] * 500 + [(None, None)] * 200), shards=8)
    assert got.groupby("shard").size().between(120, 220).all()


def test_nulls_empty_long_and_few(spark):
    check(spark, frame(spark, [(None, None), (None, ""), (1, ""), (1, None), (2, "x" * 3_000_000), (3, "y")]), shards=5)
    check(spark, frame(spark, [(1, "one")]), shards=24)
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0


def test_clashing_columns_are_replaced_and_others_kept(spark):
    names = ("size", "shard", "slot", "text_crc32", "k1", "k2", "k3", "range", "doc", "p0")
    df = frame(spark, [(1, "a b"), (2, "c")]).select("*", *[F.lit("mine").alias(n) for n in names])
    got = sharding.shard_by_bytes(df, shards=2).orderBy("doc_id").collect()
    assert [(r["size"], r.text, r.k1, r.range, r.doc, r.p0) for r in got] == [(11, "a b", *["mine"] * 4), (9, "c", *["mine"] * 4)]
    assert sorted(r.slot for r in got) == [0, 0] or len({r.shard for r in got}) == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_query(spark, sf):
    got = registry.QUERIES["op12_histogram_shards"](spark, f"/root/testdata/sf{sf}").toPandas()
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(docs.index) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for doc_id, size, crc in got[["doc_id", "size", "text_crc32"]].itertuples(index=False):
        assert (size, crc) == (len(docs[doc_id].encode()) + 8, zlib.crc32(docs[doc_id].encode()))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(registry.QUERIES["op12_histogram_shards"](spark, f"/root/testdata/sf{sf}").collect()) == set(registry.QUERIES["op12_histogram_shards"](spark, f"/root/testdata/sf{sf}").collect())
