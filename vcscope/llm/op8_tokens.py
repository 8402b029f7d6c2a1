"""Token counts from an exact histogram of encoded lengths.

Each document is encoded by the byte-level vocabulary; documents are counted by
length, and suffix sums over the lengths answer totals, quantiles and the
tokens that stay when every document is cut at a limit, for every limit.

Defined results: a null text counts as empty, an empty text has length 0; each
row counts once, repeated ones too, whatever its doc_id; an empty table gives
no rows; other columns of the input are not read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, map_arrow, slices, stage

# Lengths are summed in blocks of this many, blocks of blocks above them.
BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs: documents of each encoded length within a part of the input."""
    path = path or bpe.tokenizer_path(bpe.BYTE_LEVEL)

    def run(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [sum(counts) for counts in bpe.byte_counts(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])

    return map_arrow(docs.select("text"), run, "length long")


def _suffix(df: DataFrame, col: str) -> Column:
    """Sum of ``col`` over this and all longer lengths: blocks are summed first,
    so that no task holds more than one block's lengths or the blocks."""
    return F.sum(col).over(Window.partitionBy("block").orderBy(F.desc("length")))


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each length L that occurs:

    length, n_docs, n_tokens (of these documents), docs_from, tokens_from
    (documents of length >= L and their tokens), tokens_cut_at (tokens left when
    all documents are cut at L), share_to (share of documents of length <= L)."""
    # Written once: the sums below read it three times, the texts are encoded once.
    by = stage(lengths(docs, path).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
               .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
               .withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    blocks = by.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("high")).agg(
        F.sum("d").alias("hd"), F.sum("t").alias("ht"))
    later = Window.orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(
        "high", F.coalesce(F.sum("hd").over(later), F.lit(0)).alias("hd"),
        F.coalesce(F.sum("ht").over(later), F.lit(0)).alias("ht"),
        F.sum("hd").over(Window.partitionBy()).alias("all_docs"),
        F.sum("ht").over(Window.partitionBy()).alias("all_tokens"))
    in_high = (Window.partitionBy("high").orderBy(F.desc("block"))
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = (blocks.withColumn("high", F.floor(F.col("block") / BLOCK)).join(above, "high").select(
        "block", (F.coalesce(F.sum("d").over(in_high), F.lit(0)) + F.col("hd")).alias("d"),
        (F.coalesce(F.sum("t").over(in_high), F.lit(0)) + F.col("ht")).alias("t"),
        "all_docs", "all_tokens"))
    docs_from = _suffix(by, "n_docs") + F.col("d")
    tokens_from = _suffix(by, "n_tokens") + F.col("t")
    return by.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("length") * docs_from).alias("tokens_cut_at"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("share_to"))


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, n_docs_cut, tokens_kept for any limits, from the histogram:
    a limit takes the suffix sums of the least length at or above it."""
    each = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    total = F.sum("n_tokens").alias("all_tokens")
    over = F.col("length") > F.col("context_limit")
    return (hist.select("*", each).groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("n_docs_cut"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_kept"), total)
        .select("context_limit", "n_docs_cut", "tokens_kept", "all_tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """length: the least length that at least a share ``q`` of documents don't exceed."""
    return hist.where(F.col("share_to") >= q).agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(documents(spark, sf_dir))
