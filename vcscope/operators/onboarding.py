"""Onboarding metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import days_between
from ..plans.catalog import register
from ..tables import Tables
from .bugs import fix_flags
from .common import churn, module, r6, ratio
from .joins import range_sums


def first_commits(t: Tables, k: int) -> DataFrame:
    """Each author's first ``k`` commits (date order, hash breaks ties) with
    ``rn``. The ``row_number() <= k`` filter lets Spark keep at most k rows per
    author in every map task before the shuffle (window group limit), so a
    prolific author costs k rows per task, not all of their commits."""
    w = Window.partitionBy(*t.scope, "author").orderBy("date", "commit_hash")
    return t.commits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


@register("developer_ramp_up")
def developer_ramp_up(t: Tables, k: int = 10) -> DataFrame:
    """Days from an author's first to k-th commit; authors with fewer
    commits are still ramping up (NULL days)."""
    fk = first_commits(t, k).groupBy(*t.scope, "author").agg(
        F.max(F.when(F.col("rn") == 1, F.col("date"))).alias("first"),
        F.max(F.when(F.col("rn") == k, F.col("date"))).alias("kth"))
    counts = t.commits.groupBy(*t.scope, "author").agg(F.count("commit_hash").alias("total_commits"))
    j = fk.join(counts, t.keys("author"), "left")
    ramped = F.col("total_commits") >= k
    return j.select(
        *t.keys("author"),
        F.when(ramped, F.round(days_between("kth", "first"), 2)).alias("ramp_up_period_days"),
        F.when(ramped, F.lit("ramped up")).otherwise(F.lit("still rampingup")).alias("status"),
        "total_commits").orderBy(*t.scope, F.asc_nulls_last("ramp_up_period_days"), "author")


@register("newcomer_first_commits")
def newcomer_first_commits(t: Tables, k: int = 5) -> DataFrame:
    """Per author, over their first k commits: mean changed lines, mean
    distinct files and the test share of changed lines."""
    fc = first_commits(t, k).select("commit_hash", "repo_name", "author", churn().alias("lines"),
                                    churn("total_additions_test", "total_deletions_test").alias("test_lines"))
    files = t.file_changes.join(fc.select("commit_hash", "repo_name"), ["commit_hash", "repo_name"], "left_semi").groupBy(
        "commit_hash", "repo_name").agg(F.countDistinct("file_path").alias("files"))
    j = fc.join(files, ["commit_hash", "repo_name"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
    g = j.groupBy(*t.scope, "author").agg(F.count(F.lit(1)).alias("commits"), r6(F.avg("lines")).alias("avg_lines"),
                                r6(F.avg("files")).alias("avg_files"), F.sum("test_lines").alias("_t"),
                                F.sum("lines").alias("_l"))
    return g.select(*t.keys("author"), "commits", "avg_lines", "avg_files", r6(ratio("_t", "_l")).alias("test_share"))


@register("newcomer_hard_areas")
def newcomer_hard_areas(t: Tables, k: int = 10, days: int = 30, depth: int = 1) -> DataFrame:
    """Per module, changes made in authors' first k commits, and how
    many of them were followed by a fix commit (another commit) touching the
    same file within ``days`` days."""
    nc = first_commits(t, k).select("commit_hash", "repo_name", F.unix_seconds("date").alias("at"))
    own = (t.file_changes.join(nc, ["commit_hash", "repo_name"])
           .select(*t.keys("file_path"), "at", F.lit(0).alias("fix"), F.lit(True).alias("newcomer")))
    fixes = fix_flags(t).where("is_fix").select("commit_hash", "repo_name", F.unix_seconds("date").alias("at"))
    events = own.unionByName(t.file_changes.select("file_path", "commit_hash", "repo_name").join(
        fixes, ["commit_hash", "repo_name"]).select(*t.keys("file_path"), "at", F.lit(1).alias("fix"), F.lit(False).alias("newcomer")))
    after = range_sums(events, t.keys("file_path"), "at", days * 86400, {}, {"fixes_after": "fix"}).where("newcomer")
    g = after.groupBy(*t.scope, module("file_path", depth).alias("module")).agg(
        F.count(F.lit(1)).alias("newcomer_changes"), F.count_if(F.col("fixes_after") > 0).alias("refixed_changes"))
    return g.withColumn("refix_share", r6(ratio("refixed_changes", "newcomer_changes")))
