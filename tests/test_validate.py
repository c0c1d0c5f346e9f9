from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedmill.operators.layouts import NARROW_INPUT, WIDE_INPUT, narrow_layout, render, wide_layout
from feedmill.operators.validate import accepted, judge_lines, rejects

GOOD = {
    "info": "i", "model": "m", "id_a": "ID-A-17", "id_b": "ID-B-28", "longitude": "110.1234565", "latitude": "-21.5",
    "record_time": "2019-06-01 00:00:01", "device_code": "DEV0001", "id_c": "T9",
}


def line(**changes):
    return ",".join({**GOOD, **changes}.get(name, "") for name in WIDE_INPUT.fields)


def wide(lines_of, lines, codes=""):
    return [r.out for r in accepted(judge_lines(lines_of(lines), WIDE_INPUT, codes)).transform(wide_layout).collect()]


def test_wide_line(lines_of):
    want = "1559347201,27,,,,,ID-A-17,ID-B-2,,,,DEV0001,110.123457,-21.500000,,,,,T90000,,"
    assert want.count(",") == 20
    got = wide(lines_of, [line(), line() + "\r", "\r" + line(info="")])
    assert got == [want] * 3


def test_empty_optional_fields(lines_of):
    got = wide(lines_of, [line(id_b="", longitude="", latitude="", id_c="")])
    assert got == ["1559347201,27,,,,,ID-A-17,,,,,DEV0001,,,,,,,,,"]


REJECTS = [
    ("arity", ",".join(["x"] * 16)),
    ("arity", ",".join(["x"] * 18)),
    ("arity", ""),
    ("no_time", line(record_time="")),
    ("bad_time", line(record_time="yesterday")),
    ("bad_time", line(record_time="2019-02-30 00:00:00", id_a="")),
    ("no_id", line(id_a="")),
    ("no_id", line(id_a="", device_code="")),
    ("no_code", line(device_code="")),
    ("long_code", line(device_code="D" * 51)),
    ("long_code", line(device_code="码" * 20)),
    ("bad_longitude", line(longitude="east", latitude="x")),
    ("bad_latitude", line(latitude="1.5d")),
]


def test_first_failing_rule_names_the_reject(lines_of):
    judged = judge_lines(lines_of([text for _, text in REJECTS] + [line()]), WIDE_INPUT)
    got = [(r.reason, r.line) for r in rejects(judged).collect()]
    assert got == REJECTS
    assert accepted(judged).count() == 1


def test_allow_list(lines_of):
    lines = [line(), line(device_code="DEV0002"), line(device_code="DEV0003", longitude="x"), line(device_code="")]
    assert len(wide(lines_of, lines, "DEV0001:DEV0002")) == 2
    assert len(wide(lines_of, lines, "DEV0001")) == 1
    judged = judge_lines(lines_of(lines), WIDE_INPUT, "DEV0001")
    # Unlisted lines vanish, even with a bad number; a line without a code is still reported.
    assert [r.reason for r in rejects(judged).collect()] == ["no_code"]


def test_narrow_line(lines_of):
    good = ",".join(["a", "b", "c", "DEV0001"] + [""] * 16)
    lines = [good, good + "\r", good + ",", good.replace("DEV0001", ""), good.replace("DEV0001", "D" * 51)]
    judged = judge_lines(lines_of(lines), NARROW_INPUT)
    assert [r.out for r in accepted(judged).transform(narrow_layout).collect()] == ["0008\t8\t\tDEV0001\t01"] * 2
    assert [r.reason for r in rejects(judged).collect()] == ["arity", "no_code", "long_code"]


def test_layout_of_the_users_own(lines_of):
    rows = accepted(judge_lines(lines_of([line()]), WIDE_INPUT))
    got = rows.transform(lambda df: render(df, [F.col("device_code"), F.lit("x")], "|")).first().out
    assert got == "DEV0001|x"


FIELD = st.sampled_from(["", "x", "1.5", "-0.0000005", "2019-06-01 00:00:01", "2019-6-1 0:0:1", "码" * 17, "\r", "DEV0001", " "])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(FIELD, min_size=15, max_size=18).map(",".join), min_size=20, max_size=200))
def test_every_line_is_accepted_or_rejected_once(lines_of, lines):
    judged = judge_lines(lines_of(lines), WIDE_INPUT)
    good = accepted(judged).transform(wide_layout).collect()
    bad = rejects(judged).collect()
    assert sorted([r.line for r in good] + [r.line for r in bad]) == sorted(lines)
    assert all(r.out.count(",") == 20 for r in good)
