"""Branch and merge metrics (M42–M42e)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.timeops import days_between, iso, month
from ..plans.catalog import register
from ..tables import Tables
from .common import beside, has_keyword, r6, ratio, rdays


@register("branch_counts")
def branch_counts(t: Tables) -> DataFrame:
    """Branches created, merged and still active."""
    b = t.branches
    return b.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("branches_created"),
                 F.count("merge_date").alias("branches_merged"),
                 F.count_if(F.col("is_active") == 1).alias("branches_active"))


@register("branch_durations")
def branch_durations(t: Tables) -> DataFrame:
    """Per creation month, branches created and merged, and the mean
    days from creation to merge. Creation is the branch tip's date, so a
    duration may be zero or negative; it is reported, not clipped."""
    b = t.branches.withColumn("dur", days_between("merge_date", "creation_date"))
    return b.groupBy(*t.scope, month("creation_date").alias("month")).agg(
        F.count(F.lit(1)).alias("branches_created"), F.count("merge_date").alias("branches_merged"),
        rdays(F.avg("dur")).alias("avg_days_to_merge"))


@register("long_lived_branches")
def long_lived_branches(t: Tables, min_days: int = 30) -> DataFrame:
    """Branches open (until merge, or until the newest commit) longer
    than ``min_days``."""
    b = beside(t.branches, t.commits.groupBy(*t.scope).agg(F.max("date").alias("latest")), t.scope)
    b = b.withColumn("days_open", days_between(F.coalesce("merge_date", "latest"), "creation_date"))
    return b.where(F.col("days_open") > min_days).select(
        "branch_name", "repo_name", "is_active", rdays("days_open").alias("days_open"))


@register("merge_conflicts")
def merge_conflicts(t: Tables) -> DataFrame:
    """M42d: merge commits mentioning a conflict; resolution proxy = days
    from the newest parent to the merge."""
    m = t.commits.where((F.col("is_merge") == 1) & has_keyword("message", ["conflict"])).select(
        "commit_hash", "repo_name", "date")
    parents = t.commit_parents.join(m.select("commit_hash", "repo_name"), ["commit_hash", "repo_name"], "left_semi")
    pd = parents.join(t.commits.select(F.col("commit_hash").alias("parent_hash"), "repo_name",
                                       F.col("date").alias("parent_date")), ["parent_hash", "repo_name"], "inner")
    newest = pd.groupBy("commit_hash", "repo_name").agg(F.max("parent_date").alias("newest_parent"),
                                                         F.count(F.lit(1)).alias("parents"))
    j = m.join(newest, ["commit_hash", "repo_name"], "left")
    return j.select("commit_hash", "repo_name", iso("date").alias("date"),
                    F.coalesce("parents", F.lit(0)).alias("parents"),
                    rdays(days_between("date", "newest_parent")).alias("resolution_days"))


@register("pull_request_usage")
def pull_request_usage(t: Tables) -> DataFrame:
    """M42e: commits mentioning a pull or merge request, per month."""
    pr = has_keyword("message", vocab.PULL_REQUEST_KEYWORDS)
    g = t.commits.groupBy(*t.scope, month("date").alias("month")).agg(F.count(F.lit(1)).alias("commits"),
                                                             F.count_if(pr).alias("pr_commits"))
    return g.withColumn("pr_share", r6(ratio("pr_commits", "commits")))
