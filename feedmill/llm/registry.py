"""Queries of the operators over the given tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm import ann, chat, crosstok, decontam, jaccard, licences, mixing, negatives, quality, sharding, tokens, toxicity, urls
from feedmill.llm.samples import crc_fold
from feedmill.sources.relational import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query(
    r"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
    named AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
        FROM sized GROUP BY source),
    capped AS (
        SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
               2.0::DOUBLE * source_size::DOUBLE AS cap FROM named),
    levels AS (
        SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
               coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
               sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM capped),
    water AS (
        SELECT arg_min((budget - capped) / open_weight, ratio) AS level FROM levels WHERE (budget - capped) / open_weight <= ratio),
    targets AS (
        SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM levels LEFT JOIN water ON true),
    queued AS (
        SELECT doc_id, size, source_size, target,
               coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5(doc_id::VARCHAR), doc_id, size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
    SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
           (greatest(0, least(size, floor(target)::BIGINT - ahead))
            + greatest(0, least(size, floor(target)::BIGINT - source_size - ahead)))::BIGINT AS taken,
           ((floor(target)::BIGINT - ahead > 0 AND size > 0)::INT
            + (floor(target)::BIGINT - source_size - ahead > 0 AND size > 0)::INT)::BIGINT AS draws
    FROM queued
    """
)
def op8_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)
    return mixing.taken_per_document(draws).select("doc_id", "size", "source_size", "target", "taken", "draws")


URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@query(
    r"""
    WITH parts AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    ruled AS (
        SELECT page_id, host, path,
               CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled
    """
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge_urls(pages, urls.rule_table(spark, URL_RULES), default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licences.scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.drop("text", "places")


@query()
def op2_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 3) != 1)
    return quality.score_quality(docs, model).select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) != 0)
    return toxicity.tag_toxic(docs, model).select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_words",
        "spans",
    )


@query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_classes(docs, n=3, percent=90)


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def op1_token_lengths(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    with open(vocabulary, "rb") as ranks:
        counted = tokens.count_tokens(read_table(spark, sf_dir, "documents").select("text"), ranks.read())
    return tokens.length_curve(tokens.length_histogram(counted))


@query()
def op3_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said,
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_turns(turns))


@query()
def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))


@query()
def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sized(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lean = docs.withColumn("doc", F.col("doc").dropFields("text"))
    return sharding.place(lean, shards=24, tolerance=0.01).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, b.r AS other_r, a.label = b.label AS same,
               list_dot_product(a.c, b.c)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.c) = len(b.c)),
    positives AS (
        SELECT r, anchor_id, other_id AS positive_id, other_r AS positive_r, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id, other_r) <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM (SELECT p.anchor_id, positive_id, s.other_id AS negative_id, positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.r, positive_r ORDER BY s.score DESC, s.other_id, s.other_r)::INT AS rank
          FROM positives p JOIN scored s ON p.r = s.r AND NOT s.same
               AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    WHERE rank <= 10
    """
)
def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(
        vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256
    )


TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


@query()
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, files: tuple[str, str] = TOKENIZERS) -> DataFrame:
    vocabularies = crosstok.Vocabularies(*(Path(f).read_bytes() for f in files))
    return crosstok.align_tokenizers(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabularies)
