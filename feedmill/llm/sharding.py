"""Shards of nearly equal bytes by a histogram sort, in DataFrame functions only.

Rows have one total order: hash of the text, hash of the key, place in the staged copy. Splitters of that order are found
by counting: each round sums the exact bytes of the rows between candidate boundaries, in tasks first and then over
all of them, and keeps for every splitter either a boundary that meets the tolerance, or the one interval in which the next
round places finer boundaries. Then the rows are exchanged once, each straight to the partition of its range.

Equal texts have one hash, so they stand together, and a boundary falls within them only where no boundary beside them
would meet the tolerance: a text that a third of all rows have is cut by the hash of the key, and equal rows by their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.llm.staging import staged

# Bits by which a round refines the order's three numbers of 64 bits.
DIGITS = (16, *[8] * 6, *[8] * 8, *[8] * 8)
KEYS = ("k1", "k2", "k3")
TOTAL_BITS = 192
# Share of a range by which the edges inside a shard may miss; they place work, not rows.
LOOSE = 0.25


@dataclass
class Splitter:
    """A boundary sought at ``target`` bytes; all rows before ``prefix`` (the first ``bits`` of the order) lie below it."""

    target: int
    tolerance: float
    prefix: int = 0
    below: int = 0
    rows_below: int = 0
    edge: int | None = None


def sized(df: DataFrame, text: str = "text", key: str = "doc_id", overhead: int = 8) -> DataFrame:
    """All columns as ``doc``, with ``size`` (UTF-8 bytes of the text and ``overhead``), ``text_crc32`` and the order's hashes.

    A NULL text has no bytes, like an empty one, but is not equal to it."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.struct(*[F.col(c) for c in df.columns if c != text], *([F.col(text)] if text in df.columns else [])).alias("doc"),
        (F.octet_length(body).cast("long") + overhead).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), F.col(text)).alias("k1"),
        F.xxhash64(F.col(key).cast("string")).alias("k2"),
    )


def _unsigned_prefix(column: Column, bits: int) -> Column:
    """The first bits of a 64-bit number, smallest numbers first."""
    flipped = column.bitwiseXOR(F.lit(-(2**63)))
    return flipped if bits == 64 else F.shiftrightunsigned(flipped, 64 - bits)


def _prefix_columns(bits: int) -> list[Column]:
    """The first bits of the order as three numbers; of numbers not reached yet, 0."""
    found = []
    for i, name in enumerate(KEYS):
        own = min(64, max(0, bits - 64 * i))
        found.append((_unsigned_prefix(F.col(name), own) if own else F.lit(0).cast("long")).alias(f"p{i}"))
    return found


def _parts(prefix: int, bits: int) -> tuple[int, int, int]:
    """A prefix as the numbers that ``_prefix_columns`` gives."""
    found = []
    for i in range(3):
        own = min(64, max(0, bits - 64 * i))
        rest = max(0, bits - 64 * i - own)
        part = (prefix >> rest) & ((1 << own) - 1)
        found.append(part - (1 << 64) if part >= 1 << 63 else part)
    return tuple(found)


def _counted(rows: DataFrame, bits: int, width: int, open_prefixes: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each open prefix, (next digit, bytes, rows) of its non-empty intervals in order; nothing else reaches the driver."""
    names = ["p0", "p1", "p2"]
    found = rows.select("size", *_prefix_columns(bits), *[c.alias(f"q{i}") for i, c in enumerate(_prefix_columns(bits + width))])
    by_parts = {_parts(p, bits): p for p in open_prefixes}
    if 0 < bits <= 64:
        found = found.where(F.col("p0").isin([p0 for p0, _, _ in by_parts]))
    elif bits:
        found = found.where(F.concat_ws("/", *names).isin(["/".join(map(str, parts)) for parts in by_parts]))
    digit = F.col(f"q{bits // 64}").bitwiseAND(F.lit((1 << width) - 1))
    counts = found.groupBy(*names, digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    histogram: dict[int, list] = {p: [] for p in open_prefixes}
    for p0, p1, p2, *counted in counts.collect():
        histogram[by_parts[p0, p1, p2]].append(tuple(counted))
    return {p: sorted(own) for p, own in histogram.items()}


def _refine(splitter: Splitter, own: list[tuple[int, int, int]], bits: int, width: int, last: bool) -> None:
    """Settle on the boundary nearest the target, or go into the interval that holds it."""
    below, rows_below = splitter.below, splitter.rows_below
    # (miss, edge, rows below) of each boundary, and the interval around the target.
    best, inside = None, None
    for digit, size, rows in own:
        for edge, at, n in ((digit, below, rows_below), (digit + 1, below + size, rows_below + rows)):
            found = (abs(at - splitter.target), ((splitter.prefix << width) + edge) << (TOTAL_BITS - bits - width), n)
            best = min(best or found, found)
        if below <= splitter.target < below + size:
            inside = (digit, below, rows_below, rows)
        below, rows_below = below + size, rows_below + rows
    if last or best[0] <= splitter.tolerance or inside is None or inside[3] == 1:
        splitter.edge, splitter.rows_below = best[1], best[2]
    else:
        splitter.prefix = (splitter.prefix << width) + inside[0]
        splitter.below, splitter.rows_below = inside[1], inside[2]


def find_splitters(rows: DataFrame, total: int, shards: int, per_shard: int, tolerance: float) -> list[Splitter]:
    """Splitters of ``shards * per_shard`` ranges in order: those between shards within ``tolerance`` of a shard's share,
    or at the nearest edge of a row where a row is larger; the others, which only deal out work, more loosely."""
    ranges = shards * per_shard
    wanted = []
    for i in range(1, ranges):
        miss = tolerance * total / shards if i % per_shard == 0 else LOOSE * total / ranges
        wanted.append(Splitter(target=total * i // ranges, tolerance=miss))
    bits = 0
    for width in DIGITS:
        still = [s for s in wanted if s.edge is None]
        if not still:
            break
        histogram = _counted(rows, bits, width, sorted({s.prefix for s in still}))
        for s in still:
            _refine(s, histogram[s.prefix], bits, width, bits + width == TOTAL_BITS)
        bits += width
    # They are in order: an edge is within a quarter of a range of its target, or at an end of the row that holds the target.
    return wanted


def _signed(edge: int) -> tuple[int, int, int]:
    """An edge as the order's three signed numbers."""
    return tuple(((edge >> (64 * (2 - i))) & ((1 << 64) - 1)) - (1 << 63) for i in range(3))


def _range_of(edges: list[tuple[int, int, int]], first: int = 0) -> Column:
    """How many of the sorted edges a row has passed, by halving them."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    below, equal = F.lit(False), F.lit(True)
    for name, value in zip(KEYS, edges[middle]):
        below = below | (equal & (F.col(name) < value))
        equal = equal & (F.col(name) == value)
    return F.when(below, _range_of(edges[:middle], first)).otherwise(_range_of(edges[middle + 1 :], first + middle + 1))


def shard_by_bytes(
    df: DataFrame,
    shards: int = 24,
    tolerance: float = 0.01,
    per_shard: int | None = None,
    text: str = "text",
    key: str = "doc_id",
    overhead: int = 8,
) -> DataFrame:
    """All rows and columns of ``df`` with ``size``, ``text_crc32``, ``shard`` (from 0) and ``slot``, its place in the shard from 0.

    Every splitter of two shards misses its share of all bytes by at most ``tolerance`` of a shard, or, where a single row
    reaches over it, stands at the nearer edge of that row. The result lies in ``per_shard`` sorted ranges a shard, by
    default as many as make up the session's shuffle partitions. An empty table gives no rows. NULL and empty texts have
    ``overhead`` bytes; a text of any length is one row; repeated rows are rows of their own and may be cut apart, whichever of
    equal ones goes left; a NULL key is a key. Columns of ``df`` that have an added name are replaced.
    """
    return place(sized(df, text, key, overhead), shards, tolerance, per_shard)


def place(measured: DataFrame, shards: int = 24, tolerance: float = 0.01, per_shard: int | None = None) -> DataFrame:
    """``shard_by_bytes`` on what ``sized`` gives, of which columns of ``doc`` may have been left out."""
    spark = measured.sparkSession
    rows = staged(measured.withColumn("k3", F.monotonically_increasing_id()), "sized")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if per_shard is None:
        per_shard = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    ranges = shards * per_shard
    splitters = find_splitters(rows, total, shards, per_shard, tolerance) if total else []

    edges = [_signed(s.edge) for s in splitters if s.edge < 1 << TOTAL_BITS]
    starts = [0, *[s.rows_below for s in splitters]]
    base = F.array(*[F.lit(starts[r] - starts[r - r % per_shard]).cast("long") for r in range(len(starts))])
    within = W.partitionBy("range").orderBy(*KEYS)
    dealt = rows.withColumn("range", _range_of(edges)).repartitionById(ranges, F.col("range"))
    numbered = dealt.withColumn("slot", F.element_at(base, F.col("range") + 1) + F.row_number().over(within) - 1)
    added = ("size", "text_crc32", "shard", "slot")
    kept = [F.col(f"doc.`{c}`").alias(c) for c in measured.schema["doc"].dataType.names if c not in added]
    return numbered.select(*kept, "size", "text_crc32", F.expr(f"range div {per_shard}").cast("int").alias("shard"), "slot")
