"""Code-change metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.timeops import iso, month
from ..plans.catalog import register
from ..tables import Tables
from .common import DEFAULT_TOP_N, churn, has_keyword, module, r6, ratio, top


@register("line_totals")
def line_totals(t: Tables) -> DataFrame:
    """Added, deleted, modified (per change the smaller of the two) and
    churn over all file changes."""
    a, d = F.col("additions"), F.col("deletions")
    return t.file_changes.groupBy(*t.scope).agg(
        F.sum(a).alias("lines_added"), F.sum(d).alias("lines_deleted"),
        F.sum(F.least(a, d)).alias("lines_modified"), F.sum(a + d).alias("churn"))


@register("churn_over_time")
def churn_over_time(t: Tables) -> DataFrame:
    """Monthly churn from the per-commit totals, with the added share."""
    g = t.commits.groupBy(*t.scope, month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("total_additions").alias("lines_added"), F.sum("total_deletions").alias("lines_deleted"))
    return g.withColumn("churn", F.col("lines_added") + F.col("lines_deleted")).withColumn(
        "added_share", r6(ratio("lines_added", "churn")))


def _file_stats(t: Tables) -> DataFrame:
    return t.file_changes.groupBy(*t.scope, "file_path").agg(
        F.count(F.lit(1)).alias("changes"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.countDistinct("author").alias("authors"))


@register("file_hotspots_by_changes")
def file_hotspots_by_changes(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """M19."""
    return top(_file_stats(t), n, F.desc("changes"), F.asc("file_path"), scope=t.scope)


@register("file_hotspots_by_churn")
def file_hotspots_by_churn(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """M19."""
    return top(_file_stats(t), n, F.desc("churn"), F.asc("file_path"), scope=t.scope)


@register("module_hotspots")
def module_hotspots(t: Tables, n: int = DEFAULT_TOP_N, depth: int = 1) -> DataFrame:
    """Modules by churn."""
    g = t.file_changes.groupBy(*t.scope, module("file_path", depth).alias("module")).agg(
        F.count(F.lit(1)).alias("changes"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.countDistinct("file_path").alias("files"))
    return top(g, n, F.desc("churn"), F.asc("module"), scope=t.scope)


@register("refactoring_commits")
def refactoring_commits(t: Tables, ratio_: float = 2.0, min_churn: int = 100) -> DataFrame:
    """Refactoring keyword in the message, or a structural change
    (deletions >= ratio x additions with churn >= min_churn)."""
    kw = has_keyword("message", vocab.REFACTOR_KEYWORDS)
    structural = (F.col("total_deletions") >= F.lit(ratio_) * F.col("total_additions")) & (churn() >= min_churn)
    c = t.commits.where(kw | structural)
    return c.select("commit_hash", "repo_name", "author", iso("date").alias("date"), "total_additions",
                    "total_deletions", kw.cast("int").alias("keyword_hit"), structural.cast("int").alias("structural"))


@register("modification_complexity")
def modification_complexity(t: Tables) -> DataFrame:
    """Per file, changes, distinct authors and the mean and spread of
    changed lines per change."""
    lines = F.col("additions") + F.col("deletions")
    return t.file_changes.groupBy(*t.scope, "file_path").agg(
        F.count(F.lit(1)).alias("changes"), F.countDistinct("author").alias("authors"),
        r6(F.avg(lines)).alias("mean_lines"), r6(F.stddev_pop(lines)).alias("stddev_lines"))


def _release_dates(t: Tables) -> DataFrame:
    """Tags with their commit's date (composite key join)."""
    tags = t.tags.select("tag_name", "repo_name", F.col("tag_commit").alias("commit_hash"))
    return tags.join(t.commits.select("commit_hash", "repo_name", "date"), ["commit_hash", "repo_name"])


@register("churn_vs_releases")
def churn_vs_releases(t: Tables) -> DataFrame:
    """Monthly churn beside the number of releases tagged that month."""
    ch = t.commits.groupBy(*t.scope, month("date").alias("month")).agg(F.sum(churn()).alias("churn"))
    rel = _release_dates(t).groupBy(*t.scope, month("date").alias("month")).agg(F.count(F.lit(1)).alias("releases"))
    return ch.join(rel, t.keys("month"), "left").select(*t.keys("month"), "churn", F.coalesce("releases", F.lit(0)).alias("releases"))


@register("file_stability")
def file_stability(t: Tables, max_changes: int = 2) -> DataFrame:
    """Changes per file, least changed first; stable = few changes."""
    g = t.file_changes.groupBy(*t.scope, "file_path").agg(F.count(F.lit(1)).alias("changes"))
    return (g.select(*t.keys("file_path"), "changes", (F.col("changes") <= max_changes).cast("int").alias("is_stable"))
             .orderBy(*t.scope, "changes", "file_path"))


@register("churn_excluding_types")
def churn_excluding_types(t: Tables, exclude: Sequence[str] = ("is_dot_file", "is_build_file")) -> DataFrame:
    """Per author, commits and churn with the excluded file classes
    removed from every side: changes of those classes are dropped before any
    aggregation or join."""
    keep = F.lit(True)
    for flag in exclude:
        keep = keep & (F.col(flag) == 0)
    fc = t.file_changes.where(keep)
    return fc.groupBy(*t.scope, "author").agg(
        F.countDistinct("repo_name", "commit_hash").alias("commits"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
