import os
import re
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedmill.plans import export as X
from feedmill.plans.export import ExportRun, export_full, export_incremental, feed_rows, is_due, run_catalogue, seed
from feedmill.plans.sync import jdbc_writer_options, read_full, read_synced, sync_full, sync_incremental, write_version
from feedmill.sinks.delimited import stamp_name, write_ordered
from feedmill.sinks.delivery import PART_NAME, check_files, read_files
from feedmill.sinks.ledger import Ledger
from feedmill.spec import FeedSpec

NOW = datetime(2024, 2, 1, 6, 30, 0)
FEED = FeedSpec(
    name="facts",
    table="facts",
    key="pk",
    sql="SELECT t, pk, label, note FROM facts WHERE pk > :start_pkid AND pk <= :end_pkid",
    order_by=("t", "pk"),
    columns=("pk", "label", "label", "note"),
    chunk_rows=10,
    file_name="FACTS-[DT].dat",
)


def facts(spark, n, start=1):
    """Keys rise, times fall, so that the order is not that of the keys."""
    ids = spark.range(start, start + n).withColumnRenamed("id", "pk")
    ids.select(
        "pk",
        (F.lit(1000) - F.col("pk")).alias("t"),
        F.when(F.col("pk") % 3 == 0, None).otherwise(F.concat(F.lit("a,"), "pk")).alias("label"),
        F.lit("n").alias("note"),
    ).createOrReplaceTempView("facts")


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


@pytest.fixture
def run(tmp_path):
    return ExportRun(out_dir=str(tmp_path / "out"), now=NOW)


def files(path):
    """Lines per file name, as they stand in the files that the manifests name."""
    found = {}
    for folder, _, names in os.walk(path):
        if os.path.basename(folder) != "_manifest":
            continue
        told = pq.read_table(folder).sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
        parts = {tuple(map(int, re.match(PART_NAME, n).groups())): n for n in os.listdir(os.path.dirname(folder)) if n.startswith("part-")}
        full = {(row["part"], row["piece"]) for row in told}
        assert full <= set(parts)
        for row in told:
            with open(os.path.join(os.path.dirname(folder), parts[row["part"], row["piece"]])) as f:
                text = f.read()
            own = text.splitlines()
            assert (len(own), len(text.encode())) == (row["lines"], row["bytes"]) and row["rows"] == len(own)
            found.setdefault(row["file_name"], []).extend(own)
    return found


def lines(keys):
    return [f"{k}," + (",," if k % 3 == 0 else f"a,{k},a,{k},") + "n" for k in keys]


def test_range_and_files(spark, ledger, run):
    facts(spark, 30)
    ledger.close("facts", None, 5, 0, None)
    assert export_incremental(spark, FEED, run, ledger) == 25
    got = files(f"{run.out_dir}/feed=facts/start=5/end=30")
    assert got == {
        "FACTS-20240201063000_0001.dat": lines(range(30, 20, -1)),
        "FACTS-20240201063000_0002.dat": lines(range(20, 10, -1)),
        "FACTS-20240201063000_0003.dat": lines(range(10, 5, -1)),
    }
    assert ledger.mark("facts") == 30
    # Nothing new: no export, no entry.
    assert export_incremental(spark, FEED, run, ledger) is None
    assert ledger.done().count() == 2


def test_one_file_has_no_number(spark, ledger, run):
    facts(spark, 10)
    ledger.close("facts", None, 0, 0, None)
    assert export_incremental(spark, FEED, run, ledger) == 10
    assert list(files(run.out_dir)) == ["FACTS-20240201063000.dat"]


def test_delimiter_scrub_and_null(spark, ledger, tmp_path):
    facts(spark, 3)
    ledger.close("facts", None, 0, 0, None)
    run = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, scrub_text=True)
    export_incremental(spark, FEED, run, ledger)
    assert list(files(run.out_dir).values()) == [["3,,,n", "2,a 2,a 2,n", "1,a 1,a 1,n"]]


def test_crash_between_write_and_ledger(spark, ledger, run, monkeypatch):
    facts(spark, 12)
    ledger.close("facts", None, 0, 0, None)
    with monkeypatch.context() as crash:
        crash.setattr(Ledger, "close", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            export_incremental(spark, FEED, run, ledger)
    assert ledger.mark("facts") == 0
    # More keys arrive before the replay, which still ends where the crashed run ended.
    facts(spark, 20)
    assert export_incremental(spark, FEED, run, ledger) == 12
    assert export_incremental(spark, FEED, run, ledger) == 8
    assert ledger.mark("facts") == 20
    got = X.read_delivered(spark, "facts", ledger).collect()
    assert sorted(r.line for r in got) == sorted(lines(range(1, 21)))
    assert ledger.done().where("rows > 0").count() == 2


def test_replay_on_the_next_day_goes_to_the_same_folder(spark, ledger, tmp_path, monkeypatch):
    facts(spark, 3)
    ledger.close("facts", None, 0, 0, None)
    first = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, by_day=True)
    with monkeypatch.context() as crash:
        crash.setattr(Ledger, "close", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            export_incremental(spark, FEED, first, ledger)
    later = ExportRun(out_dir=str(tmp_path / "out"), now=NOW + timedelta(days=1), by_day=True)
    assert export_incremental(spark, FEED, later, ledger) == 3
    assert os.listdir(first.out_dir) == ["20240201"]
    assert files(first.out_dir) == {"FACTS-20240202063000.dat": lines([3, 2, 1])}


def test_audit_of_late_keys(spark, ledger, tmp_path):
    run = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, keep_keys=True)
    ledger.close("facts", None, 2, 0, None)

    def visible(*keys):
        facts(spark, 30)
        spark.table("facts").where(F.col("pk").isin(*keys)).createOrReplaceTempView("facts")

    def late(after=None):
        return sorted(r.pk for r in X.audit_late_keys(spark, FEED, run, ledger, after).collect())

    visible(1, 2, 5)
    assert late() == []
    export_incremental(spark, FEED, run, ledger)
    visible(1, 2, 3, 5, 9)
    export_incremental(spark, FEED, run, ledger)
    visible(*range(1, 12))
    # Keys up to the seeded mark and above the current one are not late.
    assert late() == [3, 4, 6, 7, 8]
    assert late(after=5) == [6, 7, 8] and late(after=9) == []
    # A range whose keys were not kept is left out.
    plain = ExportRun(out_dir=run.out_dir, now=NOW)
    export_incremental(spark, FEED, plain, ledger)
    visible(*range(1, 20))
    assert late() == [3, 4, 6, 7, 8]


def test_a_key_committed_during_the_export_is_reported(spark, ledger, tmp_path, monkeypatch):
    run = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, keep_keys=True)
    ledger.close("facts", None, 0, 0, None)
    facts(spark, 5)
    spark.table("facts").where("pk <> 3").createOrReplaceTempView("facts")
    deliver = X.deliver

    def late_commit(*args):
        result = deliver(*args)
        facts(spark, 5)
        return result

    monkeypatch.setattr(X, "deliver", late_commit)
    assert export_incremental(spark, FEED, run, ledger) == 4
    assert [r.pk for r in X.audit_late_keys(spark, FEED, run, ledger).collect()] == [3]


def test_same_range_delivered_once(spark, ledger):
    for _ in range(2):
        ledger.close("facts", 0, 5, 5, "p")
    assert ledger.done().count() == 1


def test_empty_range_moves_the_mark_and_writes_nothing(spark, ledger, run):
    facts(spark, 10)
    ledger.close("facts", None, 0, 0, None)
    feed = FeedSpec(**{**FEED.__dict__, "sql": FEED.sql + " AND note = 'x'"})
    assert export_incremental(spark, feed, run, ledger) == 0
    assert ledger.mark("facts") == 10
    assert not os.path.exists(run.out_dir) and ledger.paths("facts") == []


def test_seeding(spark, ledger, run):
    facts(spark, 7)
    spark.table("facts").where("pk < 0").createOrReplaceTempView("nothing")
    off = FeedSpec(**{**FEED.__dict__, "name": "off", "enabled": False})
    empty = FeedSpec(**{**FEED.__dict__, "name": "empty", "table": "nothing"})
    full = FeedSpec(name="full", sql="SELECT 1 AS pk", order_by=("pk",))
    seed(spark, [FEED, off, empty, full], ledger)
    assert {r.feed: r.end_key for r in ledger.done().collect()} == {"facts": 7, "off": 7, "empty": None}
    assert export_incremental(spark, FEED, run, ledger) is None
    assert export_incremental(spark, empty, run, ledger) is None
    # What fills the table later is delivered from the beginning.
    spark.table("facts").createOrReplaceTempView("nothing")
    assert export_incremental(spark, empty, run, ledger) == 7 and ledger.mark("empty") == 7
    late = FeedSpec(**{**FEED.__dict__, "name": "late"})
    assert export_incremental(spark, late, run, ledger) is None and ledger.mark("late") == 7


@pytest.mark.parametrize("per_file", [0, 4, 100])
def test_full_export(spark, ledger, run, per_file):
    facts(spark, 9)
    feed = FeedSpec(
        name="all", sql="SELECT pk, t FROM facts", order_by=("t", "pk"), columns=("pk",), chunk_rows=per_file, file_name="A.dat"
    )
    assert export_full(spark, feed, run, ledger) == 9
    got = files(run.out_dir)
    down = [str(k) for k in range(9, 0, -1)]
    if per_file == 4:
        assert got == {"A_0001.dat": down[:4], "A_0002.dat": down[4:8], "A_0003.dat": down[8:]}
    else:
        assert got == {"A.dat": down}


def test_unsplit_full_export_is_ordered_over_its_parts(spark, ledger, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.col("id"), F.lit("x").alias("v"))
        assert write_ordered(df, F.col("id").cast("string"), ("id",), str(tmp_path / "parts")) == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(n for n in os.listdir(tmp_path / "parts") if n.startswith("part-"))
    assert len(names) > 1
    text = "".join(open(tmp_path / "parts" / n).read() for n in names)
    assert text.split() == [str(i) for i in range(1000)]


def test_empty_full_export(spark, ledger, run):
    for per_file in (0, 5):
        feed = FeedSpec(name="none", sql="SELECT 1 AS pk WHERE 1 = 0", order_by=("pk",), chunk_rows=per_file)
        assert export_full(spark, feed, run, ledger) == 0
        assert files(run.out_dir) == {}


def test_days_backup_and_compression(spark, ledger, tmp_path):
    facts(spark, 5)
    run = ExportRun(
        out_dir=str(tmp_path / "out"), now=NOW, by_day=True, backup_dir=str(tmp_path / "backup"), compression="gzip"
    )
    feed = FeedSpec(name="all", sql="SELECT pk FROM facts", order_by=("pk",), file_name="A-[DT].dat")
    export_full(spark, feed, run, ledger)
    sub = "20240201/feed=all/run=20240201063000"
    for root in (run.out_dir, run.backup_dir):
        got = spark.read.text(f"{root}/{sub}").select("value").collect()
        assert [r.value for r in got] == ["1", "2", "3", "4", "5"]
        assert {r.file_name for r in read_files(spark, f"{root}/{sub}").collect()} == {"A-20240201063000.dat"}
        assert check_files(spark, f"{root}/{sub}").where("ok").count() == 1
    assert any(n.endswith(".gz") for n in os.listdir(f"{run.out_dir}/{sub}"))


def test_catalogue(spark, ledger, run):
    facts(spark, 6)
    off = FeedSpec(**{**FEED.__dict__, "name": "off", "enabled": False})
    full = FeedSpec(name="full", sql="SELECT pk FROM facts", order_by=("pk",), file_name="F.dat")
    feeds = [FEED, off, full]
    # The first run only seeds, also the feed that is off.
    assert run_catalogue(spark, feeds, run, ledger) == {}
    assert ledger.mark("facts") == ledger.mark("off") == 6 and files(run.out_dir) == {}
    facts(spark, 10)
    assert run_catalogue(spark, feeds, run, ledger) == {"facts": 4, "full": 10}
    assert ledger.mark("off") == 6
    soon = ExportRun(out_dir=run.out_dir, now=datetime.now(timezone.utc), interval_seconds=3600)
    assert run_catalogue(spark, feeds, soon, ledger) == {}
    assert FEED.rows_per_file(2000) == 10 and full.rows_per_file(2000) == 2000


def test_several_feeds_at_a_time(spark, ledger, tmp_path):
    facts(spark, 20)
    run = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, parallel=3)
    feeds = [FeedSpec(**{**FEED.__dict__, "name": f"f{i}"}) for i in range(4)]
    for i, feed in enumerate(feeds):
        ledger.close(feed.name, None, i, 0, None)
    assert run_catalogue(spark, feeds, run, ledger) == {"f0": 20, "f1": 19, "f2": 18, "f3": 17}
    assert [ledger.mark(feed.name) for feed in feeds] == [20] * 4


def test_overlap(spark, ledger, run):
    facts(spark, 10)
    ledger.close("facts", None, 8, 0, None)
    feed = FeedSpec(**{**FEED.__dict__, "overlap": 3})
    assert export_incremental(spark, feed, run, ledger) == 5
    assert list(files(run.out_dir).values()) == [lines(range(10, 5, -1))]


def test_interval(spark, ledger):
    assert is_due(ledger, datetime.now(timezone.utc), 10)
    ledger.close("facts", None, 1, 0, None)
    now = datetime.now(timezone.utc)
    assert not is_due(ledger, now, 3600)
    # Whole days count too.
    assert is_due(ledger, now + timedelta(days=2, seconds=1), 3600)


def test_compact_ledger(spark, ledger, monkeypatch):
    for k in range(1, 5):
        ledger.close("facts", k - 1, k, 1, f"p{k}")
    before = sorted(ledger.entries().collect())
    with monkeypatch.context() as crash:
        crash.setattr("feedmill.sinks.ledger.drop_dir", lambda *a: None)
        ledger.compact()
    # Both the merged and the single entries are there, and each still counts once.
    assert sorted(ledger.entries().collect()) == before
    ledger.compact()
    assert sorted(ledger.entries().collect()) == before and ledger.mark("facts") == 4
    assert len([n for n in os.listdir(f"{ledger.path}/feed=facts") if n.startswith("part-")]) == 1


def test_feed_declarations():
    with pytest.raises(ValueError, match="order_by"):
        FeedSpec(name="f", sql="SELECT 1", order_by=())
    with pytest.raises(ValueError, match="table and key"):
        FeedSpec(name="f", sql="SELECT 1", order_by=("a",), table="t")


def test_bounds_are_parameters(spark):
    facts(spark, 10)
    assert [r.pk for r in feed_rows(spark, FEED, 3, 5).orderBy("pk").collect()] == [4, 5]


def test_stamp_name():
    assert stamp_name("A-[DT].dat", NOW) == "A-20240201063000.dat"
    assert stamp_name("A-[TS].dat", NOW) == f"A-{int(NOW.timestamp())}.dat"
    assert stamp_name("A-[DT]-[DT].dat", NOW) == "A-[DT]-[DT].dat"


def test_file_numbers_beyond_four_digits_and_dots(spark):
    from feedmill.sinks.delimited import chunk_name

    df = spark.createDataFrame([(0,), (7,), (9999,), (12345,)], "chunk long")
    got = [r.n for r in df.select(chunk_name("a.b.dat", F.col("chunk")).alias("n")).collect()]
    assert got == ["a.b.dat", "a.b_0007.dat", "a.b_9999.dat", "a.b_12345.dat"]
    assert df.select(chunk_name("plain", F.col("chunk")).alias("n")).collect()[1].n == "plain_0007"


def test_sync(spark, ledger, tmp_path):
    target = str(tmp_path / "target")
    facts(spark, 10)
    assert sync_incremental(spark.table("facts"), "t", "pk", target, ledger) == 10
    assert sync_incremental(spark.table("facts"), "t", "pk", target, ledger) is None
    facts(spark, 25)
    assert sync_incremental(spark.table("facts"), "t", "pk", target, ledger) == 15
    assert sorted(r.pk for r in read_synced(spark, "t", target, ledger).collect()) == list(range(1, 26))
    plan = read_synced(spark, "t", target, ledger)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert jdbc_writer_options("u", "t")["batchsize"] == "10000"


def test_sync_before_the_first_range_and_after_a_lost_one(spark, ledger, tmp_path):
    target = str(tmp_path / "target")
    facts(spark, 10)
    spark.table("facts").where("pk < 0").createOrReplaceTempView("facts")
    assert sync_incremental(spark.table("facts"), "t", "pk", target, ledger) is None
    empty = read_synced(spark, "t", target, ledger)
    assert empty.count() == 0 and empty.columns == spark.table("facts").columns
    facts(spark, 10)
    # A range that was written and not recorded is not read.
    spark.table("facts").write.parquet(f"{target}/_start=none/_end=99")
    assert sync_incremental(spark.table("facts"), "t", "pk", target, ledger) == 10
    assert read_synced(spark, "t", target, ledger).count() == 10


def test_full_copies_are_versions(spark, ledger, tmp_path):
    target = str(tmp_path / "full")
    with pytest.raises(ValueError, match="never"):
        read_full(spark, "t", ledger)
    for n in (5, 3, 8):
        assert sync_full(spark.range(n), "t", target, ledger) == n
    before = read_full(spark, "t", ledger)
    write_version(spark.range(99), target)
    assert before.count() == 8 and read_full(spark, "t", ledger).count() == 8
    # The version before is kept for its readers; the one that was never named is dropped by the next run.
    assert sync_full(spark.range(2), "t", target, ledger) == 2
    assert before.count() == 8 and read_full(spark, "t", ledger).count() == 2
    assert len(os.listdir(target)) == 2


def test_other_users_of_the_ledger_do_not_start_the_catalogue(spark, ledger, run, tmp_path):
    facts(spark, 6)
    sync_incremental(spark.table("facts"), "copy", "pk", str(tmp_path / "target"), ledger)
    full = FeedSpec(name="full", sql="SELECT pk FROM facts", order_by=("pk",), file_name="F.dat")
    assert run_catalogue(spark, [FEED, full], run, ledger) == {}
    assert run_catalogue(spark, [FEED, full], run, ledger) == {"full": 6}
