import dataclasses
import os
import time
from threading import Event

import pytest
from pyspark.sql import functions as F

from feedmill.operators.layouts import NARROW_INPUT, WIDE_INPUT, narrow_layout, wide_layout
from feedmill.session import fresh_dir
from feedmill.sinks.ledger import MoveLog, SeenFiles
from feedmill.sources.line_files import list_files, read_lines, read_unseen, unseen_files
from feedmill.sources.relational import jdbc_options
from feedmill.plans.convert import LineFeed, convert_batch, convert_new_files, read_rejects, run_line_feeds
from feedmill.streaming.convert import convert_stream, convert_stream_parts, stream_lines
from feedmill.streaming.poll import poll_feeds
from test_validate import line


def files(path):
    """Lines per file name, as they stand in the folders of the names."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(folder, name)) as f:
                    key = os.path.basename(folder).removeprefix("file_name=")
                    assert key not in found
                    found[key] = f.read().splitlines()
    return found


def drop(folder, name, lines, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write("".join(text + end for text in lines))


def test_names_ends_and_empty_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(folder, "FEED_1.log", ["a", "b\rc", "", "d"])
    drop(folder, "feed_2.LOG", ["e"], "\r\n")
    drop(folder, "OTHER_1.log", ["no"])
    drop(folder, "X_FEED.log", ["no"])
    drop(folder, "FEED_1.txt", ["no"])
    drop(folder, "FEED_3.log", [])
    got = read_lines(spark, folder, "FEED").collect()
    assert sorted((r.file_name, r.scan_pos is not None, r.line) for r in got) == [
        ("FEED_1.log", True, ""), ("FEED_1.log", True, "a"), ("FEED_1.log", True, "b\rc"), ("FEED_1.log", True, "d"),
        ("feed_2.LOG", True, "e\r"),
    ]
    assert sorted(r.file_name for r in list_files(spark, folder, "FEED").collect()) == ["FEED_1.log", "feed_2.LOG"]


def test_files_that_do_not_match_are_not_opened(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop(folder, "FEED_1.log", ["a"])
    drop(folder, "OTHER_1.log", ["no"])
    df = read_lines(spark, folder, "FEED")
    assert [r.line for r in df.collect()] == ["a"]
    plan = df._jdf.queryExecution().executedPlan()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 1


def test_seen_names_are_dropped(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), SeenFiles(spark, str(tmp_path / "seen"))
    drop(folder, "FEED_1.log", ["a"])
    lines, found = read_unseen(spark, folder, "FEED", seen.names("f"))
    assert [r.line for r in lines.collect()] == ["a"]
    seen.add("f", found)
    drop(folder, "FEED_1.log", ["changed"])
    assert read_unseen(spark, folder, "FEED", seen.names("f")) is None
    drop(folder, "FEED_2.log", ["b"])
    lines, _ = read_unseen(spark, folder, "FEED", seen.names("f"))
    assert [r.line for r in lines.collect()] == ["b"]
    # Another feed has its own memory.
    lines, _ = read_unseen(spark, folder, "FEED", seen.names("g"))
    assert lines.count() == 2


def test_odd_file_names(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), SeenFiles(spark, str(tmp_path / "seen"))
    names = ["FEED [1].log", "FEED{a,b}.log", "FEED%20x.log"]
    for name in names:
        drop(folder, name, [name])
    lines, found = read_unseen(spark, folder, "FEED", seen.names("f"))
    assert sorted(r.line for r in lines.collect()) == sorted(names)
    seen.add("f", found)
    assert read_unseen(spark, folder, "FEED", seen.names("f")) is None


def test_compact_seen_files(spark, tmp_path):
    seen = SeenFiles(spark, str(tmp_path / "seen"))
    seen.compact()
    for name in "abc":
        seen.add("f", spark.createDataFrame([(name,)], "file_name string"))
    seen.compact()
    assert sorted(r.file_name for r in seen.names("f").collect()) == ["a", "b", "c"]
    parts = [d for d, _, names in os.walk(tmp_path / "seen") for n in names if n.startswith("part-")]
    assert len(parts) == len(set(parts)) <= 3


def beats(n, start=0):
    return [",".join(["x", "y", "z", f"DEV{i:05d}"] + [""] * 16) for i in range(start, start + n)]


def narrow(i):
    return f"0008\t8\t\tDEV{i:05d}\t01"


def test_each_accepted_line_once_in_order(spark, tmp_path):
    """5,001 lines, one of them bad: a full file of 5,000 and no repeats."""
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    lines = beats(5001)
    lines[2500] = "broken"
    drop(folder, "FEED_1.log", lines)
    drop(folder, "FEED_2.log", beats(12, 90000))
    # Small splits, so that a file is read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, folder, "FEED")
        assert lines.rdd.getNumPartitions() > 5
        convert_batch(lines, NARROW_INPUT, narrow_layout, out, bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files(out) == {
        "FEED_1.log_0001.dat": [narrow(i) for i in range(5001) if i != 2500],
        "FEED_2.log_0001.dat": [narrow(i) for i in range(90000, 90012)],
    }
    assert [(r.file_name, r.line, r.reason) for r in read_rejects(spark, bad).collect()] == [("FEED_1.log", "broken", "arity")]


def test_part_sizes_over_splits(spark, tmp_path):
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    drop(folder, "FEED_1.log", beats(1000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        convert_batch(read_lines(spark, folder, "FEED"), NARROW_INPUT, narrow_layout, out, bad, part_rows=300)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = files(out)
    assert [len(got[f"FEED_1.log_{i:04d}.dat"]) for i in (1, 2, 3, 4)] == [300, 300, 300, 100]
    assert [x for _, part in sorted(got.items()) for x in part] == [narrow(i) for i in range(1000)]
    assert read_rejects(spark, bad).count() == 0


def test_a_batch_without_accepted_lines(spark, tmp_path):
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    drop(folder, "FEED_1.log", ["x", "y"])
    convert_batch(read_lines(spark, folder, "FEED"), NARROW_INPUT, narrow_layout, out, bad)
    assert files(out) == {} and read_rejects(spark, bad).count() == 2


def run_stream(spark, folder, out, checkpoint, archive=None):
    lines = stream_lines(spark, folder, "FEED", archive)
    convert_stream(lines, WIDE_INPUT, wide_layout, out, checkpoint, once=True).awaitTermination()
    return sorted((r.reason, r.value) for r in spark.read.text(out).select("reason", "value").collect())


def test_stream_converts_each_file_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    drop(f"{folder}/a", "FEED_1.log", [line(), line(id_a="")])
    drop(f"{folder}/a", "OTHER.log", [line()])
    first = run_stream(spark, folder, out, checkpoint)
    assert [reason for reason, _ in first] == ["no_id", "ok"]
    assert run_stream(spark, folder, out, checkpoint) == first
    # The same name again, in another folder, is ignored; a new name brings its own lines only.
    drop(f"{folder}/b", "FEED_1.log", [line(id_c="again")])
    assert run_stream(spark, folder, out, checkpoint) == first
    drop(f"{folder}/b", "FEED_2.log", [line(id_c="new")])
    later = run_stream(spark, folder, out, checkpoint)
    assert len(later) == 3 and sum("new0000" in text for _, text in later) == 1


def test_stream_archives_processed_files(spark, tmp_path):
    folder, archive = str(tmp_path / "in"), str(tmp_path / "archive")
    for i in (1, 2):
        drop(folder, f"FEED_{i}.log", [line()])
        run_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "check"), archive)
    run_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "check"), archive)
    for _ in range(50):
        moved = [n for _, _, names in os.walk(archive) for n in names if n.endswith(".log")]
        if moved:
            break
        time.sleep(0.2)
    assert "FEED_1.log" in moved


def test_stream_parts_and_replayed_batch(spark, tmp_path):
    folder, out, bad, checkpoint = (str(tmp_path / d) for d in ("in", "out", "bad", "check"))
    drop(folder, "FEED_1.log", beats(25) + ["broken"])
    for _ in range(2):
        convert_stream_parts(
            stream_lines(spark, folder, "FEED"), NARROW_INPUT, narrow_layout, out, bad, checkpoint, part_rows=10, once=True
        ).awaitTermination()
    got = files(out)
    assert sorted(map(len, got.values())) == [5, 10, 10]
    assert [x for _, part in sorted(got.items()) for x in part] == [narrow(i) for i in range(25)]
    assert [r.reason for r in read_rejects(spark, bad).collect()] == ["arity"]
    # The commit of the batch is lost: it runs again and replaces its own files.
    os.remove(f"{checkpoint}/commits/0")
    if os.path.exists(f"{checkpoint}/commits/.0.crc"):
        os.remove(f"{checkpoint}/commits/.0.crc")
    convert_stream_parts(
        stream_lines(spark, folder, "FEED"), NARROW_INPUT, narrow_layout, out, bad, checkpoint, part_rows=10, once=True
    ).awaitTermination()
    assert files(out) == got


def test_staging_lies_under_the_shared_folder(spark):
    from feedmill.session import shared_dir

    assert fresh_dir(spark, "x").startswith(shared_dir(spark) + "/feedmill/x-")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", spark.sparkContext.getCheckpointDir())


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from feedmill.session import shared_dir

    def session(master, conf):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=context)

    assert shared_dir(session("spark://x:7077", {"spark.checkpoint.dir": "s3://b/c/"})) == "s3://b/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://x:7077", {}))


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "(select 1) q", user="u") == {
        "url": "jdbc:x", "dbtable": "(select 1) q", "fetchsize": "10000", "user": "u",
    }
    got = jdbc_options("jdbc:x", "facts", "pk", (1, 900), 8)
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("pk", "1", "900", "8")


def test_line_feeds(spark, tmp_path):
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    seen = SeenFiles(spark, str(tmp_path / "seen"))
    on = LineFeed("beats", folder, "FEED", NARROW_INPUT, narrow_layout, part_rows=4)
    off = LineFeed("off", folder, "FEED", NARROW_INPUT, narrow_layout, enabled=False)
    drop(folder, "FEED_1.log", beats(5) + ["broken"])
    assert run_line_feeds(spark, [on, off], out, bad, seen) == ["beats"]
    assert run_line_feeds(spark, [on, off], out, bad, seen) == []
    drop(folder, "FEED_2.log", beats(2, 100))
    assert run_line_feeds(spark, [on, off], out, bad, seen) == ["beats"]
    want = {
        "FEED_1.log_0001.dat": [narrow(i) for i in range(4)],
        "FEED_1.log_0002.dat": [narrow(4)],
        "FEED_2.log_0001.dat": [narrow(100), narrow(101)],
    }
    assert files(out) == want
    assert [r.reason for r in read_rejects(spark, bad).collect()] == ["arity"]
    # The names are lost after the write: the same files are converted into the same outputs.
    forgetful = SeenFiles(spark, str(tmp_path / "other"))
    assert convert_new_files(spark, on, out, bad, forgetful).count() == 2
    assert files(out) == want and read_rejects(spark, bad).count() == 1


def test_register_jdbc_bounds_the_new_keys(spark, monkeypatch):
    from feedmill.sources import relational

    calls = []

    def read(spark, url, table, **options):
        calls.append(options)
        return spark.range(1, 11).withColumnRenamed("id", "pk")

    monkeypatch.setattr(relational, "read_jdbc", read)
    monkeypatch.setattr(relational, "max_key_jdbc", lambda spark, url, table, key, above, **o: 10 if above < 10 else None)
    relational.register_jdbc(spark, "jdbc:x", "db_facts", "pk", 4, num_partitions=8)
    assert calls[-1] == {"num_partitions": 8, "key": "pk", "bounds": (4, 10)}
    assert spark.table("db_facts").count() == 10
    relational.register_jdbc(spark, "jdbc:x", "db_facts", "pk", 10)
    assert calls[-1] == {}


def test_the_database_finds_the_highest_key():
    from feedmill.sources.relational import max_key_options

    assert max_key_options("jdbc:x", "t", "pk", 4, user="u") == {
        "url": "jdbc:x",
        "dbtable": "(select max(pk) as top_key from t where pk > 4) q",
        "user": "u",
    }
    assert max_key_options("jdbc:x", "t", "pk")["dbtable"] == "(select max(pk) as top_key from t) q"


def test_a_late_old_file_is_converted_by_the_stream(spark, tmp_path):
    """A file a month older than the newest one is new all the same; a name that returns is not."""
    from feedmill.streaming.convert import stream_lines

    folder, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(folder)

    def drop(name, text, days):
        (folder / name).write_text(text)
        old = time.time() - days * 86_400
        os.utime(folder / name, (old, old))

    def poll():
        lines = stream_lines(spark, str(folder), "a")
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    drop("a1.log", "new", 0)
    assert poll() == ["new"]
    drop("a2.log", "late", 30)
    drop("a1.log", "again", 0)
    assert poll() == ["late", "new"]


def test_processed_files_are_moved_and_a_lost_run_is_taken_up(spark, tmp_path, monkeypatch):
    folder, archive, out, bad = (str(tmp_path / d) for d in ("in", "old", "out", "bad"))
    seen, moves = SeenFiles(spark, str(tmp_path / "seen")), MoveLog(spark, str(tmp_path / "moves"))
    feed = LineFeed("f", folder, "FEED", NARROW_INPUT, narrow_layout, archive=archive)
    drop(folder, "FEED_1.log", beats(3))
    drop(folder, "FEED [2].log", beats(2))
    drop(folder, "OTHER.log", ["x"])
    with monkeypatch.context() as crash:
        crash.setattr("feedmill.plans.archive.move_paths", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_line_feeds(spark, [feed], out, bad, seen, moves)
    assert moves.pending("f").count() == 2 and len(os.listdir(folder)) == 3
    # One of the two was moved before the run was lost.
    os.makedirs(archive)
    os.rename(f"{folder}/FEED_1.log", f"{archive}/FEED_1.log")
    assert run_line_feeds(spark, [feed], out, bad, seen, moves) == []
    assert sorted(os.listdir(archive)) == ["FEED [2].log", "FEED_1.log"] and os.listdir(folder) == ["OTHER.log"]
    assert moves.pending("f").isEmpty()
    # A name that comes again is known, and stays where it is.
    drop(folder, "FEED_1.log", beats(1))
    assert run_line_feeds(spark, [feed], out, bad, seen, moves) == [] and "FEED_1.log" in os.listdir(folder)


def test_bytes_of_any_encoding_come_through(spark, tmp_path):
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    os.makedirs(folder)
    codes = ["设备一", "é" * 40, "码" * 25, "码" * 26, "plain"]
    with open(f"{folder}/FEED_1.log", "wb") as f:
        f.write("".join(",".join(["a", "b", "c", code] + [""] * 16) + "\r\n" for code in codes).encode("gb18030") + b",,,\xff\xfe" + b"," * 16 + b"\n")
    gbk = dataclasses.replace(NARROW_INPUT, encoding="gb18030")
    convert_batch(read_lines(spark, folder, "FEED"), gbk, narrow_layout, out, bad)
    (part,) = [f"{d}/{n}" for d, _, names in os.walk(out) for n in names if n.startswith("part-")]
    want = [b"0008\t8\t\t" + code.encode("gb18030") + b"\t01" for code in (codes[0], codes[2], codes[4])] + [b"0008\t8\t\t\xff\xfe\t01"]
    assert open(part, "rb").read().split(b"\n")[:-1] == want
    assert sorted(r.reason for r in read_rejects(spark, bad).collect()) == ["long_code", "long_code"]
    convert_batch(read_lines(spark, folder, "FEED"), gbk, narrow_layout, out, bad, codes="设备一:plain")
    (part,) = [f"{d}/{n}" for d, _, names in os.walk(out) for n in names if n.startswith("part-")]
    assert len(open(part, "rb").read().splitlines()) == 2
    convert_batch(read_lines(spark, folder, "FEED"), dataclasses.replace(gbk, validated=True), narrow_layout, out, bad)
    reasons = [r.reason for r in read_rejects(spark, bad).collect()]
    assert reasons.count("bad_encoding") == 5


def test_names_are_looked_up_in_their_parts_only(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), SeenFiles(spark, str(tmp_path / "seen"))
    seen.add("f", spark.range(5000).select(F.concat(F.lit("FEED_"), "id", F.lit(".log")).alias("file_name")))
    drop(folder, "FEED_17.log", ["known"])
    drop(folder, "FEED_x.log", ["new"])
    fresh = unseen_files(list_files(spark, folder, "FEED"), seen.names("f"))
    assert [r.file_name for r in fresh.collect()] == ["FEED_x.log"]
    assert "dynamicpruning" in fresh._jdf.queryExecution().executedPlan().toString()


def test_polls_end_and_keep_their_period(spark, tmp_path):
    folder, out, bad = (str(tmp_path / d) for d in ("in", "out", "bad"))
    seen, stop = SeenFiles(spark, str(tmp_path / "seen")), Event()
    feed = LineFeed("f", folder, "FEED", NARROW_INPUT, narrow_layout)
    drop(folder, "FEED_1.log", beats(3))
    polls = poll_feeds(spark, [feed], out, bad, seen, period=0.01, stop=stop, compact_every=1)
    assert next(polls) == ["f"] and next(polls) == []
    drop(folder, "FEED_1.log", beats(5))
    assert next(polls) == []
    drop(folder, "FEED_2.log", beats(2))
    assert next(polls) == ["f"]
    stop.set()
    assert list(polls) == [] and len(files(out)) == 2
