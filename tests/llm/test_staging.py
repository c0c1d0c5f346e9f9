"""Staged tables go with the innermost scratch around them, kept ones with the one around that."""

import os

import pyarrow.parquet as pq
import pytest

from feedmill.llm.staging import scratch, staged


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scratch(spark):
    outside = folder(staged(spark.range(3), "test"))
    with scratch(spark):
        with scratch(spark):
            inner, kept = folder(staged(spark.range(3), "test")), folder(staged(spark.range(3), "test", keep=True))
        assert not os.path.exists(inner) and os.path.exists(kept)
        own = folder(staged(spark.range(3), "test"))
    assert not os.path.exists(kept) and not os.path.exists(own) and os.path.exists(outside)
    with pytest.raises(ValueError), scratch(spark):
        lost, result = folder(staged(spark.range(3), "test")), folder(staged(spark.range(3), "test", keep=True))
        raise ValueError
    assert not os.path.exists(lost) and os.path.exists(result)


def test_room_of_texts(spark, tmp_path):
    # Words of a few hundred in any order, as prose has them.
    words = "array_join(transform(sequence(1, 200), i -> concat('word', pmod(xxhash64(id, i), 500))), ' ')"
    texts = spark.range(0, 2000, 1, 1).selectExpr("id", f"{words} AS text")
    texts.write.parquet(str(tmp_path / "plain"))
    room = [sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles()) for df in (staged(texts, "test"), spark.read.parquet(str(tmp_path / "plain")))]
    assert room[0] < 0.8 * room[1]
    own = pq.ParquetFile(staged(texts, "test").inputFiles()[0].removeprefix("file://")).metadata.row_group(0).column(1)
    assert own.compression == "ZSTD" and staged(texts, "test").exceptAll(texts).isEmpty()
