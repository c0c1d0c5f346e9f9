"""From raw documents to a training mix: five stages over the documents table, each kept as a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm import decontam, jaccard, mixing, quality, toxicity
from feedmill.llm.samples import crc_fold
from feedmill.llm.staging import staged
from feedmill.sources.relational import read_table

# The stages rest on learned models, which SQL cannot express.
ORACLE_SQL = None


def apart(docs: DataFrame) -> DataFrame:
    """Rows as one column ``doc``, so that what an operator adds meets no column of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic score is under one half. The model learns from labels of crc32 folds 1 to 4 of 5."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 5) != 0)
    return toxicity.tag_toxic(apart(docs), model, text="doc.text").where("score < 0.5").select("doc.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half. The model learns from labels of crc32 folds 0 and 2 of 3."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 3) != 1)
    return quality.score_quality(apart(docs), model, text="doc.text").where("score >= 0.5").select("doc.*")


def numbered(docs: DataFrame) -> DataFrame:
    """A staged copy: each row as ``doc``, its own number ``row``, and a ``digest`` that orders rows alike on every run."""
    rows = apart(docs).withColumn("digest", F.xxhash64(*[F.col(f"doc.`{c}`") for c in docs.columns]))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, directly or not, the one of smallest id.

    Rows are compared by their texts alone: rows of one id, or of none, whose texts are unlike all stay. NULL ids come last.
    Documents without words link with nothing, and each of them stays.
    """
    rows = numbered(docs)
    classes = jaccard.jaccard_classes(rows.select("row", F.col("doc.text").alias("text")), n=5, percent=80, key="row")
    classes = staged(classes.withColumnRenamed("row", "of"), "near-duplicates")
    found = rows.select("row", "digest", "doc.doc_id").join(classes.where("n_shingles > 0"), F.col("row") == F.col("of"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")).alias("first")
    linked = found.groupBy("component_id").agg(first).select("first.row")
    kept = staged(linked.union(classes.where("n_shingles = 0").select("of")), "kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    found = decontam.find_leaks(apart(docs), read_table(spark, sf_dir, "benchmark"), text="doc.text")
    return found.where(F.size("leaks") == 0).select("doc.*")


ADDED = ("size", "source_size", "target", "taken", "draws")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, with their ``size``, source's ``target``, words ``taken`` and number of ``draws``.

    Rows that repeat an id, or have none, are documents of their own. Columns of documents that have an added name are
    replaced, as this is the last stage."""
    rows = numbered(docs)
    lean = rows.select("doc.doc_id", "doc.text", "doc.source", "digest", "row")
    draws = mixing.mix(lean, weights=(5, 2, 1), share=1.5, repeats=2, carried=("digest", "row"))
    taken = mixing.taken_per_document(draws, carried=("row",)).where("taken > 0")
    drawn = taken.select(F.col("row").alias("of"), *ADDED)
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ADDED]
    return rows.join(drawn, F.col("row") == F.col("of")).select(*kept, *ADDED)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again before the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
