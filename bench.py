"""Time the registered queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores; arguments choose queries (default: all).
Every query is run in full into a sink that discards rows, once to warm up and then timed; of the
headline queries the middle of five runs counts, as the JVM compiles their code only after a few.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedmill.registry import QUERIES  # noqa: E402
from feedmill.session import local_session  # noqa: E402
from feedmill.sources.relational import read_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("incremental_export", "chunk_assignment", "fixed_layout_wide", "charset_whitelist")
# Rows each headline query starts from.
INPUT = {
    "incremental_export": ("orders",),
    "chunk_assignment": ("events",),
    "fixed_layout_wide": ("events",),
    "charset_whitelist": ("pages", "documents"),
}


def run(spark, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    seconds = {}
    for name in sys.argv[1:] or QUERIES:
        run(spark, name)
        times = 5 if name in HEADLINE else 1
        seconds[name] = median(run(spark, name) for _ in range(times))
    headline = [n for n in HEADLINE if n in seconds]
    rate = {
        n: round(sum(read_table(spark, SF_DIR, t).count() for t in INPUT[n]) / seconds[n]) for n in headline
    }
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds[n] for n in headline), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rate,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
