"""A corpus cleaned and packed: quality rules, line dedup, near-duplicate
removal, secret redaction, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vcscope.llm import op1_jaccard, op3_secrets, op7_lines, op9_packing, op10_quality
from vcscope.llm.common import documents, stage

# Near duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that the rules remove. Rows
    without doc_id go; of a doc_id given more than once all rows stay if one is kept."""
    return op10_quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; a
    document that loses all its lines goes. Null doc_ids come last; rows equal in
    doc_id and text are one."""
    return op7_lines.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates. Rows without
    doc_id cannot be named by a group and go; of the rows of one doc_id one stays, if
    any of them is the least of its group. Null and empty texts are groups of their own."""
    groups = stage(op1_jaccard.components(docs, NEAR_WORDS, NEAR_PERCENT).where("doc_id IS NOT NULL"), "near-groups")
    ids = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"),
                                       F.max(F.col("doc_id") == F.col("component_id")).alias("least"))
    # Short lists, written so that their size is known: texts stay where they are
    # while the lists can be broadcast.
    gone = stage(ids.where("NOT least").select(F.col("doc_id").alias("_gone_id")), "near-gone")
    again = stage(ids.where("least AND n > 1").select(F.col("doc_id").alias("_again_id")), "near-again")
    kept = docs.where("doc_id IS NOT NULL").join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    if again.isEmpty():
        return kept
    many = docs.join(again, docs["doc_id"] == again["_again_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, docs["doc_id"] == again["_again_id"], "left_anti").unionByName(many)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; null texts stay null."""
    return op3_secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences: a null or empty text is one
    piece of one token, rows of one doc_id are documents of their own."""
    return op9_packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

# Shingle hashes, edit distances and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
