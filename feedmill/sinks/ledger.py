"""Progress of feeds as append-only tables in a shared folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.session import drop_dir

LEDGER_SCHEMA = (
    "feed string, start_key long, end_key long, rows long, path string, state string, committed_at timestamp"
)
# Feed name under which runs of the whole catalogue are recorded.
RUNS = "_catalogue"
DIGEST_SCHEMA = "feed string, block long, keys long, digest long, path string"
MOVE_SCHEMA = "feed string, source string, target string, state string, at timestamp"
SEEN_SCHEMA = "feed string, bucket int, file_name string, seen_at timestamp"
# Parts of a feed's names.
BUCKETS = 64


class AppendOnly:
    """A table that grows by small files, in a folder per feed. One writer per feed."""

    schema: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def append(self, feed: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/feed={feed}")

    def read(self) -> DataFrame:
        """The table, or no rows before its first append."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """Merge the files of each feed into one; to be run while no feed is.

        A crash in between leaves rows twice, which readers tell by their equal times and ignore.
        """
        if self.read().isEmpty():
            return
        rows = self.read()
        merged = [r.file_path for r in rows.select("_metadata.file_path").distinct().collect()]
        for feed in [r.feed for r in rows.select("feed").distinct().collect()]:
            self.append(feed, rows.where(F.col("feed") == feed).drop("feed").distinct().coalesce(1))
        for file_path in merged:
            drop_dir(self.spark, file_path)


class Ledger(AppendOnly):
    """Ranges of each feed: ``open`` when an export has fixed its bounds, ``done`` once delivered,
    ``keys`` when the keys it may deliver were kept; and ``run`` for each run of the catalogue.

    An open range that was never done is a crashed export: the next run repeats the same bounds,
    writes to the same path and so replaces whatever the crash left there.
    """

    schema = LEDGER_SCHEMA

    def _append(self, feed, start, end, rows, path, state) -> None:
        entry = self.spark.sql(
            """
            SELECT cast(:start AS bigint) AS start_key, cast(:end AS bigint) AS end_key, cast(:rows AS bigint) AS rows,
                   cast(:path AS string) AS path, :state AS state, current_timestamp() AS committed_at
            """,
            args={"start": start, "end": end, "rows": rows, "path": path, "state": state},
        )
        self.append(feed, entry)

    def entries(self) -> DataFrame:
        """All entries, each once; look-ups for which repeats do not matter read the table as it is."""
        return self.read().distinct()

    def done(self) -> DataFrame:
        return self.entries().where("state = 'done'")

    def mark(self, feed: str) -> int | None:
        """Highest key delivered or seeded for the feed; None also for one seeded from the beginning."""
        return self.position(feed)[1]

    def position(self, feed: str) -> tuple[bool, int | None]:
        """Whether the feed was seeded, and its mark."""
        row = self.read().where((F.col("state") == "done") & (F.col("feed") == feed)).agg(F.count(F.lit(1)).alias("n"), F.max("end_key").alias("top")).first()
        return row["n"] > 0, row["top"]

    def keep_keys(self, feed: str, start: int | None, end: int, path: str) -> None:
        """Record that the keys of a range were kept, and where."""
        self._append(feed, start, end, None, path, "keys")

    def record_run(self) -> None:
        """Record that the catalogue has run, whatever it delivered."""
        self._append(RUNS, None, None, None, None, "run")

    def kept_keys(self, feed: str) -> DataFrame:
        """Ranges whose keys were kept, each with the place of its latest copy: one that was repeated replaces the earlier."""
        kept = self.entries().where((F.col("feed") == feed) & (F.col("state") == "keys"))
        return kept.groupBy("start_key", "end_key").agg(F.max_by("path", "committed_at").alias("path"))

    def name_version(self, feed: str, path: str, rows: int) -> None:
        """Make a version of a table that is copied in full the current one."""
        self._append(feed, None, None, rows, path, "version")

    def versions(self, feed: str) -> list[str]:
        """Paths of the versions that were ever current, the current one first. One row for each full copy of the table."""
        named = self.entries().where((F.col("feed") == feed) & (F.col("state") == "version"))
        return [r.path for r in named.orderBy(F.desc("committed_at"), F.desc("path")).select("path").collect()]

    def started(self, feeds: list[str]) -> bool:
        """Whether a run of the catalogue, or an export or seed of one of its feeds, was recorded; other users of the ledger do not count."""
        own = (F.col("state") == "run") | ((F.col("state") == "done") & F.col("feed").isin(feeds))
        return not self.read().where(own).isEmpty()

    def open_range(self, feed: str, start: int | None, end: int, place: str = "") -> tuple[int, str]:
        """Fix the end of the next range and the place it is written to.

        A crashed export of the same start keeps both, so that its replay replaces what it left.
        """
        pending = self.read().where(
            (F.col("feed") == feed) & F.col("start_key").eqNullSafe(F.lit(start)) & (F.col("state") == "open")
        )
        first = pending.orderBy("committed_at").select("end_key", "path").first()
        if first is not None:
            return first.end_key, first.path
        self._append(feed, start, end, None, place, "open")
        return end, place

    def close(self, feed: str, start: int | None, end: int, rows: int, path: str | None) -> None:
        """Record delivery, once per range."""
        known = self.read().where(
            (F.col("state") == "done")
            & (F.col("feed") == feed)
            & F.col("start_key").eqNullSafe(F.lit(start))
            & F.col("end_key").eqNullSafe(F.lit(end))
        )
        if end is None or known.isEmpty():
            self._append(feed, start, end, rows, path, "done")

    def paths(self, feed: str) -> list[str]:
        """Folders of delivered ranges; readers trust no others."""
        found = self.done().where((F.col("feed") == feed) & F.col("path").isNotNull())
        return [row.path for row in found.select("path").distinct().toLocalIterator()]

    def last_run(self) -> datetime | None:
        """When the latest run or delivery was recorded, in UTC."""
        micros = self.read().where("state IN ('done', 'run')").agg(F.unix_micros(F.max("committed_at"))).first()[0]
        return None if micros is None else datetime.fromtimestamp(micros / 1e6, timezone.utc)


class KeyDigests(AppendOnly):
    """Digests of the keys of each range, by block; ``path`` is where the keys themselves are."""

    schema = DIGEST_SCHEMA

    def add(self, feed: str, digests: DataFrame, path: str) -> None:
        self.append(feed, digests.select("block", "keys", "digest", F.lit(path).alias("path")).coalesce(1))


def name_bucket(file_name: Column) -> Column:
    return F.pmod(F.xxhash64(file_name), F.lit(BUCKETS)).cast("int")


class SeenFiles(AppendOnly):
    """Names of input files already processed, in parts by their hash, so that a few names are looked up in a few parts."""

    schema = SEEN_SCHEMA

    def append(self, feed: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/feed={feed}")

    def names(self, feed: str) -> DataFrame:
        return self.read().where(F.col("feed") == feed).select("bucket", "file_name")

    def add(self, feed: str, files: DataFrame) -> None:
        named = files.select(name_bucket(F.col("file_name")).alias("bucket"), "file_name", F.current_timestamp().alias("seen_at"))
        self.append(feed, named.repartition(1))


class MoveLog(AppendOnly):
    """Moves of processed files: ``planned`` before the first of them is made, ``moved`` after."""

    schema = MOVE_SCHEMA

    def record(self, feed: str, moves: DataFrame, state: str) -> None:
        told = moves.select("source", "target", F.lit(state).alias("state"), F.current_timestamp().alias("at"))
        self.append(feed, told.coalesce(1))

    def pending(self, feed: str) -> DataFrame:
        """Moves that were planned and not recorded as made since. A name may be planned again when its file comes again."""
        last = self.read().where(F.col("feed") == feed).groupBy("source", "target").agg(F.max(F.struct("at", "state")).alias("last"))
        return last.where("last.state = 'planned'").select("source", "target")
