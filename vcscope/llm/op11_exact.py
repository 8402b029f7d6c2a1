"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are the same without their white space; a text's
digest is the SHA-256 of what is left. The digests are written once. A
Misra-Gries summary (Spark's frequent-items sketch: bounded counters, all of them
lowered together when they run full) of each part of the digests, merged in two
steps, names the candidates: every digest with more than about 3.5 / COUNTERS of
all rows is among them. A second pass counts the candidates exactly and finds
their winners with map-side aggregation; the verified ones, at most COUNTERS
rows, are broadcast and their copies leave the data where they are read. What
remains has no large group and is grouped by an ordinary shuffle.

Of equal texts the row with the most code points in its original text stays,
then the smallest doc_id.

Defined results: a null text counts as empty, so null, empty and blank texts are
one group; a null doc_id comes after all others, and keep_id is null only where
no row of the group has a doc_id; of rows equal in length and doc_id one stays;
an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, null_text, stage

# Counters of a summary: bounds its memory, the candidates and the broadcast rows.
COUNTERS = 4096
# Summaries are merged in so many groups first, then those with each other.
MERGES = 64
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text_sha256, row: written, read back; ``row`` tells repeated rows apart."""
    t = null_text()
    return stage(docs.select("doc_id", F.length(t).cast("long").alias("n_chars"),
                             F.sha2(normalised(t), 256).alias("text_sha256"),
                             F.monotonically_increasing_id().alias("row")), "digests")


def candidates(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """text_sha256 of at most ``counters`` digests, every frequent one among them."""
    parts = rows.groupBy((F.spark_partition_id() % MERGES).alias("merge")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("summary"))
    # One group, and none of an empty table (which a summary cannot be of).
    merged = parts.groupBy(F.floor(F.col("merge") / MERGES).alias("all")).agg(
        F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {counters})")).alias("c")).select(
        "c.item").where("item IS NOT NULL").withColumnRenamed(
        "item", "text_sha256")


def _better() -> Column:
    """Orders rows of one group: the greatest stays."""
    return F.struct("n_chars", F.col("doc_id").isNotNull().alias("numbered"),
                    F.bitwise_not("doc_id").alias("place"), F.bitwise_not("row").alias("first"))


def winners(rows: DataFrame) -> DataFrame:
    """text_sha256, group_size, best: the row that stays of each digest."""
    return rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(_better()).alias("best"))


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The winners of the candidates that an exact count finds frequent (a
    ``counters``-th of all rows or more, two at least), written."""
    least = max(2, -(-rows.count() // counters))
    found = rows.join(F.broadcast(candidates(rows, counters)), "text_sha256", "left_semi")
    return stage(winners(found).where(F.col("group_size") >= least), "frequent")


def marked(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    rows = digests(docs)
    heavy = frequent(rows, counters)
    hot = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(winners(rest), "text_sha256")
    keep = F.bitwise_not("best.place")
    return hot.unionByName(cold).select(
        "doc_id", keep.alias("keep_id"), "group_size",
        (F.col("row") == F.bitwise_not("best.first")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(documents(spark, sf_dir))


ORACLE_SQL = r"""WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
best AS (SELECT text_sha256, count(*) AS group_size, max(n) AS n FROM d GROUP BY text_sha256),
stays AS (SELECT d.text_sha256, min(d.doc_id) AS keep_id FROM d JOIN best b
  ON d.text_sha256 = b.text_sha256 AND d.n = b.n GROUP BY d.text_sha256)
SELECT d.doc_id, s.keep_id, b.group_size, d.doc_id = s.keep_id AS kept, d.text_sha256
FROM d JOIN best b USING (text_sha256) JOIN stays s USING (text_sha256)"""
