"""Line validation: every line is accepted, or rejected for its first failing rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions.columns import (
    byte_text,
    epoch_seconds,
    is_printable,
    present,
    split_line,
    strip_line_end,
)
from feedmill.spec import LineFormat


def field_count(line: Column, delimiter: str = ",") -> Column:
    return F.size(split_line(line, delimiter))


def parse_lines(lines: DataFrame, fmt: LineFormat) -> DataFrame:
    """The input columns plus ``n_fields`` and one column per field (NULL beyond a short line), as :func:`byte_text`.

    Exploding the one split line keeps later filters above the split; pushed below, they would
    repeat it for every field they look at.
    """
    split = split_line(strip_line_end(byte_text(F.col("line"))), fmt.delimiter)
    fields = lines.select(*lines.columns, F.explode(F.array(split)).alias("_fields"))
    return fields.select(
        *lines.columns,
        F.size("_fields").alias("n_fields"),
        *[F.get("_fields", F.lit(i)).alias(name) for i, name in enumerate(fmt.fields)],
    )


def reject_reason(fmt: LineFormat) -> Column:
    """Name of the first failing rule over parsed fields, NULL for a good line."""
    rules = [("bad_encoding", ~F.is_valid_utf8("line"))] if fmt.validated else []
    rules.append(("arity", F.col("n_fields") != len(fmt.fields)))
    if fmt.time_field:
        time = F.col(fmt.time_field)
        rules += [("no_time", ~present(time)), ("bad_time", epoch_seconds(time).isNull())]
    if fmt.id_field:
        rules.append(("no_id", ~present(F.col(fmt.id_field))))
    code = F.col(fmt.code_field)
    rules += [("no_code", ~present(code)), ("long_code", F.length(code) > fmt.max_code_bytes)]
    for name in fmt.number_fields:
        rules.append((f"bad_{name}", present(F.col(name)) & ~is_printable(F.col(name))))
    reason = F.lit(None).cast("string")
    for label, failed in reversed(rules):
        reason = F.when(failed, F.lit(label)).otherwise(reason)
    return reason


def judge_lines(lines: DataFrame, fmt: LineFormat, codes: str = "") -> DataFrame:
    """Parsed lines with ``reason``.

    With a code list such as ``a:b:c``, lines that pass up to the code but are not listed vanish:
    they are neither accepted nor reported.
    """
    judged = parse_lines(lines, fmt).withColumn("reason", reject_reason(fmt))
    if not codes:
        return judged
    reached_list = F.col("reason").isNull() | F.col("reason").isin([f"bad_{n}" for n in fmt.number_fields])
    return judged.where(~reached_list | F.col(fmt.code_field).isin([fmt.as_bytes(code) for code in codes.split(":")]))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NULL").drop("reason", "n_fields")


def rejects(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL").select("file_name", "line", "reason")
