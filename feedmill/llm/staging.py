"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from feedmill.session import drop_dir, fresh_dir

_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside at the end, but for those staged with ``keep``. Nothing else that is made from them may be
    read afterwards."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            drop_dir(spark, path)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a table and read it back: its size is known, its rows stay the same, lost executors lose none of it.

    It stays in the shared folder, because the frames made from it read it whenever they run, until the innermost ``scratch``
    around it ends; with ``keep`` until the one around that does. Without any it stays for good. Texts take a third less
    room by zstd than by Spark's default.
    """
    path = fresh_dir(df.sparkSession, label)
    scopes = _OPEN.__dict__.get("scopes", [])[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
