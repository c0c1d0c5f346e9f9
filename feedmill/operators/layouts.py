"""Fixed output layouts: a layout turns accepted rows into one ``out`` line each.

A layout is any function DataFrame -> DataFrame that adds ``out``; use it with df.transform.
The two here render positional records from opaque strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions.columns import add_suffix, delimited_line, drop_last, epoch_seconds, float_six, text_bytes
from feedmill.spec import LineFormat

Layout = Callable[[DataFrame], DataFrame]

# Fixed values of the two layouts and their input lines.
WIDE_KIND = "27"
WIDE_SUFFIX = "0000"
NARROW_HEAD = ("0008", "8", "")
NARROW_STATE = "01"
WIDE_INPUT = LineFormat(
    fields=(
        "c0", "c1", "c2", "id_a", "id_b", "longitude", "latitude", "record_time", "c8", "c9", "c10", "c11", "c12",
        "device_code", "c14", "c15", "id_c",
    ),
    code_field="device_code",
    time_field="record_time",
    id_field="id_a",
    number_fields=("longitude", "latitude"),
)
NARROW_INPUT = LineFormat(
    fields=("c0", "c1", "c2", "device_code", *[f"c{i}" for i in range(4, 20)]),
    code_field="device_code",
)


def render(df: DataFrame, columns: list[Column], delimiter: str) -> DataFrame:
    """A layout from a user's own column list, over fields of accepted lines; ``out`` has their bytes."""
    return df.withColumn("out", text_bytes(delimited_line(columns, delimiter)))


def _blank(n: int) -> list[Column]:
    return [F.lit("")] * n


def wide_layout(df: DataFrame) -> DataFrame:
    """21 comma fields from accepted WIDE_INPUT rows."""
    columns = [
        epoch_seconds(F.col("record_time")),
        F.lit(WIDE_KIND),
        *_blank(4),
        F.col("id_a"),
        drop_last(F.col("id_b")),
        *_blank(3),
        F.col("device_code"),
        float_six(F.col("longitude")),
        float_six(F.col("latitude")),
        *_blank(4),
        add_suffix(F.col("id_c"), WIDE_SUFFIX),
        *_blank(2),
    ]
    return render(df, columns, ",")


def narrow_layout(df: DataFrame) -> DataFrame:
    """5 tab fields from accepted NARROW_INPUT rows."""
    return render(df, [*map(F.lit, NARROW_HEAD), F.col("device_code"), F.lit(NARROW_STATE)], "\t")
