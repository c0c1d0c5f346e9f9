"""URL filter: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm.staging import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A block is one row of four 64-bit words; a key sets one bit in each.
WORDS = 4
KEYS_PER_BLOCK = 16


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, ASCII letters lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    names = ("rule_host", "rule_path", "rule_verdict")
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, rule)]) for rule in rules or [(None,) * 3]]
    return spark.range(1).select(F.inline(F.array(*rows))).where("rule_host IS NOT NULL")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(bits, 6 * i), F.lit(64)).cast("int"))
        for i in range(WORDS)
    ]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Filter of ``key``: a row (block, w0..w3) for each block that has a key."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def candidate_keys(urls: DataFrame, path_lengths: list[int], label_counts: list[int]) -> DataFrame:
    """Every (host or parent domain, path prefix) of ``url`` that a rule could name, by the lengths and numbers of labels rules have."""
    held = F.filter(F.array(*[F.lit(n) for n in label_counts]), lambda n: n <= label_count(F.col("host")))
    parents = F.transform(held, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.left(F.col("path"), n))
    return (
        urls.withColumn("parent", F.explode(F.array_distinct(parents)))
        .withColumn("prefix", F.explode(prefixes))
        .select("url", "host", "path", _key(F.col("parent"), F.col("prefix")).alias("key"))
    )


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each of the distinct ``urls`` (url, host, path): url, rule, rule_verdict.

    The filter has one block per 16 rules, 64 bits or so a rule; Spark broadcasts it while it is under
    spark.sql.autoBroadcastJoinThreshold and shuffles both sides by block beyond. Only keys that may be listed reach
    the exact join. The distinct path lengths and numbers of
    host labels of the rules are collected, one number each; of a URL's host only parents with so many labels are made.
    """
    listed = staged(
        rules.select(
            _key(F.col("rule_host"), F.col("rule_path")).alias("key"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "rule_verdict",
        ).where(F.col("key").isNotNull()),
        "rules",
    )
    count = listed.count()
    lengths = rules.where("rule_path IS NOT NULL").select(F.length("rule_path").alias("n")).distinct()
    path_lengths = sorted(r.n for r in lengths.toLocalIterator())
    labels = rules.where("rule_host IS NOT NULL").select(label_count(F.col("rule_host")).alias("n")).distinct()
    label_counts = sorted(r.n for r in labels.toLocalIterator())
    if not count:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).where("false")
    blocks = -(-count // KEYS_PER_BLOCK)
    bloom = staged(bloom_blocks(listed.select("key").distinct(), blocks), "bloom")
    keys = candidate_keys(urls, path_lengths, label_counts).withColumn("_block", _block(F.col("key"), blocks))
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = keys.join(bloom, F.col("_block") == F.col("block")).where(hit).select("url", "key")
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best")
    return possible.join(listed, "key").groupBy("url").agg(best).select("url", "best.rule", "best.rule_verdict")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` of each row's URL, replacing columns of these names.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest wins, and of
    equal rules with different verdicts the greater verdict. Without a rule the verdict is ``default``. NULL and URLs
    without '://' have an empty host and path. Each distinct URL is judged once, so one that holds most rows costs
    one row until the join back, whose hot partitions adaptive execution splits. Repeated rows stay.
    """
    kept = df.select(*[c for c in df.columns if c not in ("host", "path", "rule", "verdict")])
    distinct = df.select(F.col(url).alias("url")).where(F.col(url).contains("://")).distinct()
    parted = distinct.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    judged = match_rules(parted, rules).withColumnRenamed("url", "_judged")
    return kept.join(judged, F.col(url) == F.col("_judged"), "left").select(
        *kept.columns,
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        "rule",
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
    )
