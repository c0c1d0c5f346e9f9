"""Column functions. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHITESPACE = " \t\n\r\x0b\x0c"
TIME_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"

# Whole parts from 2**63 on do not fit a long; such numbers are not printed but rejected.
WHOLE_LIMIT = 9.223372036854775807e18
# Dekker's splitter for 53-bit doubles: 2**27 + 1.
SPLITTER = 134217729.0


def time_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a date or time, fractions cut off.

    A time without zone is never moved into the session's zone, where its hour may not exist.
    """
    return F.left(ts.cast("timestamp_ntz").cast("string"), F.lit(19))


def present(text: Column) -> Column:
    """True when the value is neither NULL nor the empty string."""
    return F.coalesce(text != "", F.lit(False))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER_PATTERN), F.lit(False))


def is_printable(text: Column) -> Column:
    """A number whose six decimals :func:`float_six` can print: a finite double with a whole part below 2**63."""
    double = F.trim(text, F.lit(WHITESPACE)).try_cast("double")
    return is_number(text) & F.coalesce(F.abs(double) < WHOLE_LIMIT, F.lit(False))


def decimal_six(text: Column, strict: bool = False) -> Column:
    """Number text with up to three integer digits and six decimals, rounded half away from zero.

    NULL when the value is missing. An unreadable or too wide one is NULL as well, see
    :func:`decimal_six_bad`; ``strict`` makes it fail the job.
    """
    number = F.nullif(F.trim(text), F.lit(""))
    return (number.cast if strict else number.try_cast)("decimal(9,6)").cast("string")


def decimal_six_bad(text: Column) -> Column:
    return present(F.trim(text)) & decimal_six(text).isNull()


def float_six(text: Column) -> Column:
    """Six decimals of the nearest double, ties in its exact binary value going to even.

    Decimal arithmetic on the text would differ when the seventh decimal is a final 5, because
    the double lies a little above or below the tie. The double is cut into its whole part and its
    fraction, both exact. The fraction's product with 10**6 is split into its rounded value and
    its exact error, and the error decides ties. Missing stays empty; what :func:`is_printable`
    refuses gives NULL.
    """
    number = F.when(is_printable(text), F.trim(text, F.lit(WHITESPACE)))
    double = F.abs(number.cast("double"))
    whole = F.floor(double)
    value = double - whole.cast("double")
    scaled = value * F.lit(1e6)
    spread = value * F.lit(SPLITTER)
    high = spread - (spread - value)
    error = (high * F.lit(1e6) - scaled) + (value - high) * F.lit(1e6)
    nearest = F.rint(scaled)
    rest = scaled - nearest
    up = ((rest == 0.5) & (error > 0)).cast("long")
    down = ((rest == -0.5) & (error < 0)).cast("long")
    units = nearest.cast("long") + up - down
    carry = units.cast("long") == 1_000_000
    # '-0.0' and values that round to zero from below keep their sign, as C formatting does.
    sign = F.when(number.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(
        sign,
        (whole + carry.cast("long")).cast("string"),
        F.lit("."),
        F.lpad(F.when(carry, F.lit(0)).otherwise(units).cast("string"), 6, "0"),
    )
    # Every step is used at the top of the expression, where Spark computes repeated parts once.
    return F.coalesce(exact, F.when(~present(text), F.lit("")))


def scrub(text: Column, delimiter: str = ",", by: str = " ") -> Column:
    """Keep a delimiter and line ends out of a value."""
    if len(delimiter) == len(by) == 1:
        return F.translate(text, "\r\n" + delimiter, by * 3)
    inline = F.translate(text, "\r\n", by * 2) if len(by) == 1 else F.regexp_replace(text, "[\r\n]", by)
    return F.replace(inline, F.lit(delimiter), F.lit(by))


def whitelist(text: Column) -> Column:
    """Keep ASCII letters and digits, '|' and '-', turn '#' into '/', drop the rest; nothing left is NULL."""
    kept = F.regexp_replace(text, r"[^\p{Alnum}|#-]+", "")
    return F.nullif(F.replace(kept, F.lit("#"), F.lit("/")), F.lit(""))


def concat_text(*parts: Column) -> Column:
    """Concatenation in which NULL counts as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def byte_text(line: Column) -> Column:
    """A line's bytes as one character each, so that every text function works on bytes and loses none of them."""
    return F.decode(line.cast("binary"), "ISO-8859-1")


def text_bytes(text: Column) -> Column:
    """The bytes that :func:`byte_text` stands for, as a line again."""
    return F.encode(text, "ISO-8859-1").cast("string")


def split_line(line: Column, delimiter: str = ",") -> Column:
    """All fields of a line, trailing empty ones included; no quoting."""
    quoted = delimiter if delimiter not in r".$|()[{^?*+\\" else "\\" + delimiter
    return F.split(line, quoted, -1)


def strip_line_end(line: Column) -> Column:
    return F.trim(line, F.lit("\r"))


def epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of a session-zone time text; unpadded parts are fine, bad is NULL."""
    readable = F.when(text.rlike(TIME_PATTERN), F.regexp_replace(text, r"\s+", " "))
    return F.unix_timestamp(F.try_to_timestamp(readable, F.lit("yyyy-M-d H:m:s")))


def drop_last(text: Column) -> Column:
    """Without the last character; empty stays empty."""
    return F.left(text, F.length(text) - 1)


def add_suffix(text: Column, suffix: str) -> Column:
    return F.when(present(text), F.concat(text, F.lit(suffix))).otherwise(F.lit(""))


def too_long(text: Column, limit: int) -> Column:
    """Length is counted in bytes."""
    return F.octet_length(text) > limit


def delimited_line(columns: list[Column], delimiter: str = ",") -> Column:
    """One text line from columns by position; NULL is empty."""
    return F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
