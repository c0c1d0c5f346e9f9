"""Files by part and piece, and the manifest that names and proves them."""

import os

import pytest
from pyspark.sql import functions as F

from feedmill.operators.chunks import number_rows
from feedmill.plans import export as X
from feedmill.plans.export import ExportRun, export_full
from feedmill.sinks.delivery import PART_NAME, check_files, file_manifest, plan_files, read_files, read_manifest, write_files, write_manifest
from feedmill.sinks.ledger import Ledger
from feedmill.spec import FeedSpec
from test_export import NOW


@pytest.mark.parametrize(
    ("total", "per_file", "tasks", "want"),
    [
        (10, 10, 4, (False, 1, 1)),
        (11, 10, 4, (True, 2, 2)),
        (95, 10, 4, (True, 10, 4)),
        (1, 0, 4, (False, 1, 1)),
        (1_000_000, 0, 4, (False, 4, 4)),
        (250_000, 0, 4, (False, 3, 3)),
    ],
)
def test_plans(total, per_file, tasks, want):
    plan = plan_files("A.dat", total, per_file, tasks)
    assert (plan.split, plan.pieces, plan.parts) == want
    assert plan.per_piece * plan.pieces >= total > plan.per_piece * (plan.pieces - 1)


def delivered(spark, df, line, path, per_file, tasks, order=("id",), key="id"):
    numbered = number_rows(df, order)
    plan = plan_files("A.dat", numbered.total(), per_file, tasks)
    write_files(numbered.rows, line, plan, path)
    write_manifest(file_manifest(numbered.rows, line, plan, key), path)
    numbered.release()
    return plan


def test_many_files_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    plan = delivered(spark, spark.range(1005), F.col("id").cast("string"), path, 10, 4)
    assert [n for n in os.listdir(path) if os.path.isdir(f"{path}/{n}")] == ["_manifest"]
    assert plan.parts == 4 and len([n for n in os.listdir(path) if n.startswith("part-")]) == 101
    got = read_files(spark, path).collect()
    assert {(r.file_name, r.position, int(r.line)) for r in got} == {(f"A_{i // 10 + 1:04}.dat", i % 10 + 1, i) for i in range(1005)}
    told = {r.file_name: r for r in read_manifest(spark, path).collect()}
    assert (told["A_0101.dat"].rows, told["A_0101.dat"].min_key, told["A_0101.dat"].max_key, told["A_0101.dat"].first_row) == (5, 1000, 1004, 1001)


def test_unsplit_in_parts_is_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("feedmill.sinks.delivery.UNSPLIT_ROWS", 100)
    path = str(tmp_path / "out")
    assert delivered(spark, spark.range(950), F.col("id").cast("string"), path, 0, 4).parts == 4
    got = read_files(spark, path).orderBy("position").collect()
    assert [(r.file_name, r.position, int(r.line)) for r in got] == [("A.dat", i + 1, i) for i in range(950)]


def test_damage_and_strangers_are_found(spark, tmp_path):
    path = str(tmp_path / "out")
    delivered(spark, spark.range(50), F.col("id").cast("string"), path, 10, 2)
    assert check_files(spark, path).where("ok").count() == 5 and check_files(spark, path).where("NOT ok").isEmpty()
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    with open(f"{path}/{parts[1]}", "a") as f:
        f.write("more\n")
    os.remove(f"{path}/.{parts[1]}.crc")
    with open(f"{path}/part-00099-own-c000.txt", "w") as f:
        f.write("stranger\n")
    bad = check_files(spark, path).where("NOT ok").collect()
    assert {(r.part, r.piece) for r in bad} == {(0, 1), (99, 0)}
    assert "stranger" not in {r.line for r in read_files(spark, path).collect()}


def test_line_ends_inside_values(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(6)
    delivered(spark, df, F.concat(F.col("id").cast("string"), F.when(F.col("id") == 2, "\nx").otherwise("")), path, 2, 2)
    assert check_files(spark, path).where("NOT ok").isEmpty()
    told = {r.file_name: (r.rows, r.lines) for r in read_manifest(spark, path).collect()}
    assert told == {"A_0001.dat": (2, 2), "A_0002.dat": (2, 3), "A_0003.dat": (2, 2)}


def test_the_source_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(5000).mapInArrow(count, "id long")
    numbered = number_rows(df, ("id",))
    assert numbered.total() == 5000 and numbered.rows.where("rn <> id + 1").isEmpty()
    assert read.value == 5000
    numbered.release()


def test_a_backup_that_differs_fails_the_export(spark, tmp_path, monkeypatch):
    spark.range(30).createOrReplaceTempView("thirty")
    feed = FeedSpec(name="all", sql="SELECT id FROM thirty", order_by=("id",), chunk_rows=10, file_name="A.dat")
    run = ExportRun(out_dir=str(tmp_path / "out"), now=NOW, backup_dir=str(tmp_path / "backup"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert export_full(spark, feed, run, ledger) == 30
    write = X.write_files

    def torn(rows, line, plan, path, compression):
        write(rows.where("rn <> 7") if "backup" in path else rows, line, plan, path, compression)

    monkeypatch.setattr(X, "write_files", torn)
    later = ExportRun(out_dir=str(tmp_path / "out2"), now=NOW, backup_dir=str(tmp_path / "backup2"))
    with pytest.raises(RuntimeError, match="manifest"):
        export_full(spark, feed, later, ledger)
    assert ledger.done().count() == 1


def test_names_of_parts():
    import re

    assert re.match(PART_NAME, "part-00012-0c0f-c0ab-c003.txt.gz").groups() == ("00012", "003")
    assert re.match(PART_NAME, "part-00012-0c0f-c0ab-c1003.txt").groups() == ("00012", "1003")
