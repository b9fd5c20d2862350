"""The corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``.  ``run`` writes each stage's result as Parquet to the shared folder and reads it back as
the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ersa.llm import jaccard_join, packing, quality_classifier, quality_rules, substring_dedup
from ersa.llm.common import documents, store


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    return quality_rules.clean_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says good.

    Both kinds are needed to learn the difference, and the rules may have left only one of them, so the
    labelled rows of the documents table are learnt from (those that the classifier may learn from).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, labels, train=documents(spark, sf_dir))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id; rows that share it, once.

    Near duplicates share 80% of their shingles of five words (``op4_jaccard_join`` by itself: 85%, four).
    Rows without a doc_id stay, as each is a group of its own.
    """
    groups = jaccard_join.jaccard_components(docs, gram=5, percent=80).select("doc_id", "component_id")
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    # rows of one id are one document: the alphabetically first text speaks
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(first, F.col("doc_id") == F.col("__first"), "left_semi")
    twice = first.join(docs.groupBy(F.col("doc_id").alias("__first")).count().where("count > 1").select("__first"), "__first", "left_semi")
    single = kept.join(twice, F.col("doc_id") == F.col("__first"), "left_anti")
    chosen = kept.join(twice, F.col("doc_id") == F.col("__first"), "left_semi") \
        .groupBy("doc_id").agg(F.min_by(F.struct(*names), "text").alias("r")).select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
    return single.unionByName(chosen).unionByName(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words that start earlier."""
    return substring_dedup.dedup_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Compression and tokenising cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
