"""Tables the feeds select from: a database over JDBC, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def jdbc_options(
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 32,
    fetch_rows: int = 10_000,
    **connection: str,
) -> dict[str, str]:
    """Reader options; with a key and its bounds the table is read in parallel key ranges.

    The bounds only place the range edges, rows outside them are still read. ``connection``
    takes user, password and driver, which belong in the Spark conf or the environment.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **connection}
    if key and bounds:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(num_partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def max_key_options(url: str, table: str, key: str, above: int | None = None, **connection: str) -> dict[str, str]:
    """Reader options that let the database find the highest key (above a mark): one row comes back."""
    newer = "" if above is None else f" where {key} > {int(above)}"
    return {"url": url, "dbtable": f"(select max({key}) as top_key from {table}{newer}) q", **connection}


def max_key_jdbc(spark: SparkSession, url: str, table: str, key: str, above: int | None = None, **options) -> int | None:
    """Highest key of a database table (above a mark), found by the database."""
    connection = {name: v for name, v in options.items() if name not in ("num_partitions", "fetch_rows")}
    return spark.read.format("jdbc").options(**max_key_options(url, table, key, above, **connection)).load().first()[0]


def key_edges(keys: DataFrame, key: str, ranges: int, above: int | None = None) -> list[int]:
    """Edges that cut the keys (above a mark) into ranges with about equally many rows, however the keys are spread.

    They are quantiles, computed in tasks and merged; NULL keys count for none. Fewer edges come back where one key has
    more rows than a range. Decimal keys may lie beyond a long; their quantiles are doubles, which every other key is compared as, too.
    """
    newer = keys if above is None else keys.where(F.col(key) > above)
    shares = [i / ranges for i in range(1, ranges)]
    number = F.col(key).cast("double" if isinstance(newer.select(key).schema[0].dataType, DecimalType) else "long")
    found = newer.agg(F.percentile_approx(number, shares, 100 * ranges)).first()[0] if shares else None
    return sorted({int(edge) for edge in found or []})


def range_predicates(key: str, edges: list[int], above: int | None = None) -> list[str]:
    """One condition per range between the edges, above the mark. Together they hold for every row above it, or, without a
    mark, for every row, also one without a key; no row meets two."""
    lower = [above, *edges]
    found = []
    for i, low in enumerate(lower):
        parts = [] if low is None else [f"{key} > {int(low)}"]
        parts += [f"{key} <= {int(edges[i])}"] if i < len(edges) else []
        found.append(" AND ".join(parts) or "1 = 1")
    if above is None and edges:
        found[0] = f"({found[0]} OR {key} IS NULL)"
    return found


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, predicates: list[str], fetch_rows: int = 10_000, **connection: str) -> DataFrame:
    """Read a database table in parallel, a partition for each condition."""
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_rows), **connection})


def register_jdbc(spark: SparkSession, url: str, table: str, key: str, mark: int, even: bool = False, num_partitions: int = 32, **options) -> None:
    """Make a keyed database table known by name, read in parallel ranges of its keys above the mark.

    The ranges are of equal width between mark and highest key, or, with ``even``, hold equally many rows; that reads the key
    column once more, so it pays where keys are sparse or bunched.
    """
    top = max_key_jdbc(spark, url, table, key, mark, **options)
    ranged = options if top is None else {**options, "key": key, "bounds": (mark, top), "num_partitions": num_partitions}
    if not even or top is None:
        read_jdbc(spark, url, table, **ranged).createOrReplaceTempView(table)
        return
    keys = read_jdbc(spark, url, f"(select {key} from {table} where {key} > {int(mark)}) q", **ranged)
    predicates = range_predicates(key, key_edges(keys, key, num_partitions), mark)
    read_jdbc_ranges(spark, url, table, predicates, **options).createOrReplaceTempView(table)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make Parquet tables known by name, as the feeds' SQL expects them."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
