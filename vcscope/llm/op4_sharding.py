"""Balanced contiguous shards by a global prefix sum of byte sizes.

Documents are put in doc_id order by range partitions; the partitions' totals
give each one its place in the whole, and running sums inside a partition place
its documents. The total is cut at equal targets, so every shard differs from
the target by less than one document at each end. Only ids, sizes and checksums
move, never texts.

Defined results: a null text has the 8 bytes of its frame alone; a null doc_id
comes first; repeated rows are placed one after the other (by size, checksum,
then any order); an empty table gives no rows; a document larger than a target
fills its shard alone and may leave a neighbour empty; other columns of the
input are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, null_text, shuffle_partitions, stage

FRAME_BYTES = 8
SHARDS = 24


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, prefix_bytes."""
    spark = docs.sparkSession
    slim = docs.select(
        "doc_id",
        (F.octet_length(null_text()) + F.lit(FRAME_BYTES)).cast("long").alias("size"),
        F.crc32(null_text().cast("binary")).alias("text_crc32"),
    ).withColumn("tie", F.monotonically_increasing_id())
    # One range of ids per partition; the tie lets a repeated id spread over several.
    placed = stage(
        slim.repartitionByRange(shuffle_partitions(spark), "doc_id", "size", "text_crc32", "tie")
        .sortWithinPartitions("doc_id", "size", "text_crc32", "tie")
        .withColumn("part", F.spark_partition_id()), "shards")

    # As many rows as partitions: their totals, then the sum before each.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))

    within = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32", "tie")
    run = (placed
           .withColumn("run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
           .withColumn("nth", F.row_number().over(within))
           .join(parts, "part"))
    start = F.coalesce("run", F.lit(0)) + F.col("bytes_before")
    # The shard in whose target the document's middle lies (exact integers).
    middle = (2 * start + F.col("size")).cast("decimal(38,0)")
    run = run.select(
        "doc_id", "size", "text_crc32", start.alias("prefix_bytes"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        F.least(F.lit(n_shards - 1),
                F.floor(middle * n_shards / (2 * F.col("total")))).cast("int").alias("shard"))
    first = run.groupBy("shard").agg(F.min("place").alias("first"))
    return run.join(F.broadcast(first), "shard").select(  # at most n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "prefix_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


# CRC-32 by its rule: eight shifts of a byte make a table's entry.
ORACLE_SQL = f"""WITH crc_table AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(1, 9)),
  lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS b))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {FRAME_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM d, crc_table),
placed AS (SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER () AS total, row_number() OVER o AS nth
  FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
cut AS (SELECT *, CAST(least({SHARDS - 1}, (2 * start + size) * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(start AS BIGINT) AS prefix_bytes FROM cut"""
