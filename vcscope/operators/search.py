"""Keyword search by a gram index (M68), so that a search doesn't read the history.

Texts are commit messages and distinct paths, in lower case and numbered densely.
``postings`` lists for each gram of ``GRAM`` characters, and each block of
``BLOCK`` numbers, the texts that hold it, in the order of grams; ``texts`` holds the
texts by block. A term's texts hold all of its grams: the postings of these few grams
are read (the others are pruned by the order), intersected block by block, and the
candidates' blocks alone are read to verify them. A term shorter than a gram is within
some gram of every text that holds it; texts shorter than a gram are grams themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..plans.catalog import register
from ..session import staged
from ..tables import Tables
from .stats import dense_numbers

GRAM = 3
BLOCK = 32_768


def grams(text: str = "text") -> Column:
    """The distinct grams of a text; a shorter one is its own."""
    t = F.col(text)
    parts = F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda p: F.substring(t, p, F.lit(GRAM)))
    return F.when(F.length(t) >= GRAM, F.array_distinct(parts)).when(F.length(t) > 0, F.array(t)).otherwise(
        F.array().cast("array<string>"))


def numbered_texts(t: Tables) -> DataFrame:
    """no, kind (m: message, p: path), repo_name and commit_hash (of messages), path, text."""
    none = F.lit(None).cast("string")
    docs = t.commits.select(F.lit("m").alias("kind"), "repo_name", "commit_hash", none.alias("path"),
                            F.lower("message").alias("text")).unionByName(
        t.file_changes.select("file_path").distinct().select(
            F.lit("p").alias("kind"), none.alias("repo_name"), none.alias("commit_hash"),
            F.col("file_path").alias("path"), F.lower("file_path").alias("text"))).where("length(text) > 0")
    keyed = staged(docs.withColumn("d", F.struct("kind", "repo_name", "commit_hash", "path")), "search-docs")
    numbers = dense_numbers(keyed.select("d").distinct(), "d")
    # Keys may hold nulls on one side each: the join is on what is not.
    key = [F.coalesce(F.col(f"d.{c}"), F.lit("")).alias(f"_{c}") for c in ("repo_name", "commit_hash", "path")]
    on = ["kind", "_repo_name", "_commit_hash", "_path"]
    n = numbers.select("no", F.col("d.kind").alias("kind"), *key)
    return keyed.select(*docs.columns, *key).join(n, on).select(
        "no", *docs.columns, F.floor(F.col("no") / BLOCK).cast("int").alias("block"))


def build(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(texts, postings), to be written ``partitionBy("block")`` and in the order of grams."""
    texts = staged(numbered_texts(t), "search-texts")
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    # A list holds the numbers of one block at most.
    postings = texts.select("no", "block", F.explode(grams()).alias("gram")).groupBy("gram", "block").agg(
        F.sort_array(F.collect_list("no")).alias("nos"))
    return texts, postings.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block")


def write_index(t: Tables, path: str) -> None:
    """Write the index of ``t`` to a folder."""
    texts, postings = build(t)
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartitionByRange(n, "block", "no").write.mode("overwrite").partitionBy("block").parquet(
        f"{path.rstrip('/')}/texts")
    postings.write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path.rstrip('/')}/postings")


def index_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(texts, postings) of a handle: written with its store, or made when first asked for."""
    if "search-index" not in t.derived:
        from ..session import scratch_folder
        path = t.search or scratch_folder(t.spark, "search")
        if t.search is None:
            write_index(t, path)
        t.derived["search-index"] = (t.spark.read.parquet(f"{path}/texts"), t.spark.read.parquet(f"{path}/postings"))
    return t.derived["search-index"]


def candidates(postings: DataFrame, term: str) -> DataFrame:
    """block, no: texts that hold all grams of a (lower-case) term."""
    if len(term) < GRAM:
        held = postings.where(F.contains("gram", F.lit(term)))
        return held.select("block", F.explode("nos").alias("no")).distinct()
    need = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
    lists = postings.where(F.col("gram").isin(*need)).groupBy("block").agg(F.collect_list("nos").alias("all"))
    both = F.reduce(F.slice("all", 2, len(need)), F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return lists.where(F.size("all") == len(need)).select("block", F.explode(both).alias("no"))


def matching_texts(t: Tables, terms: Sequence[str]) -> DataFrame:
    """The texts (without regard to case) that hold one of the terms."""
    texts, postings = index_of(t)
    lower = [x.lower() for x in terms if x]
    if not lower:
        return texts.limit(0)
    found = None
    for term in lower:
        c = candidates(postings, term)
        found = c if found is None else found.unionByName(c)
    # Written, so that its size decides how the texts' blocks are pruned.
    found = staged(found.distinct(), "search-candidates")
    return texts.join(found, ["block", "no"]).where(F.col("text").rlike(vocab.keyword_regex(lower)))


def search(t: Tables, terms: Sequence[str]) -> DataFrame:
    """commit_hash, repo_name: commits whose message or any changed path holds a
    term, as ``keyword_search`` finds them by scanning."""
    hits = staged(matching_texts(t, terms), "search-hits")
    by_path = t.file_changes.select("commit_hash", "repo_name", "file_path").join(
        hits.where("kind = 'p'").select(F.col("path").alias("file_path")), "file_path")
    return hits.where("kind = 'm'").select("commit_hash", "repo_name").unionByName(
        by_path.select("commit_hash", "repo_name")).distinct()


@register("keyword_search_indexed")
def keyword_search_indexed(t: Tables, terms: Sequence[str] = ("conflict", "readme")) -> DataFrame:
    """M68 by the gram index."""
    return search(t, terms)
