"""Run every registered query and compare it with its SQL in DuckDB: python tests/check_queries.py [sf_dir] [name...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as spark_entry
from feedmill.session import local_session

QUERIES, ORACLE = spark_entry.queries(), spark_entry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(frame):
    """Sorted rows as text, columns in name order."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if v is None or v != v else str(v) for v in row) for row in frame.itertuples(index=False))


def compare(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLE:
        return f"{got.num_rows} rows, no SQL"
    want = con.sql(ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names), (got.column_names, want.column_names)
    for column in got.column_names:
        kinds = str(got.schema.field(column).type), str(want.schema.field(column).type)
        if kinds[0] != kinds[1]:
            print("   type of", column, kinds)
    a, b = (
        normal(t.to_pandas(integer_object_nulls=True, timestamp_as_object=True)) for t in (got, want)
    )
    assert len(a) == len(b), f"rows {len(a)} != {len(b)}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]
    return f"{len(a)} rows equal"


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    failed = []
    for name in names:
        begin = time.time()
        try:
            print(f"{name}: {compare(spark, con, sf_dir, name)} {time.time() - begin:.2f}s", flush=True)
        except Exception:
            failed.append(name)
            print(f"{name}: FAILED\n{traceback.format_exc()[-1500:]}", flush=True)
    print("failed:", failed)
