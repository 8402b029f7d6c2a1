"""Release metrics.

A release is a tag; its time is the tagged commit's date. Tags are ordered by
that date (repository, then tag name break ties) and release *i* covers the
commits with date > date(i−1) and <= date(i). Releases of all repositories follow
one another, and are told apart by (repository, tag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import days_between, iso, month
from ..plans.catalog import register
from ..tables import Tables
from .bugs import fix_flags
from .common import DEFAULT_TOP_N, beside, churn, for_each_scope, r6, ratio, rdays, top
from .joins import window_join
from .sequence import segmented_lag


def release_windows(t: Tables) -> DataFrame:
    """repo_name, tag_name, rel_date, prev_repo, prev_tag, prev_date (NULL for
    the first release)."""
    tags = t.tags.select("tag_name", "repo_name", F.col("tag_commit").alias("commit_hash"))
    dated = tags.join(t.commits.select("commit_hash", "repo_name", F.col("date").alias("rel_date")),
                      ["commit_hash", "repo_name"]).select("repo_name", "tag_name", "rel_date")
    dated = dated.withColumn("_rel", F.struct("repo_name", "tag_name", "rel_date"))
    lagged = segmented_lag(dated, t.scope, ["rel_date", "repo_name", "tag_name"], "_rel", (1,), prefix="_prev")
    return lagged.select("repo_name", "tag_name", "rel_date", F.col("_prev1.repo_name").alias("prev_repo"),
                         F.col("_prev1.tag_name").alias("prev_tag"), F.col("_prev1.rel_date").alias("prev_date"))


def _commits_in_releases(t: Tables, how: str = "inner", first: bool = True) -> DataFrame:
    w = release_windows(t)
    if not first:
        w = w.where(F.col("prev_date").isNotNull())
    c = fix_flags(t).select(*t.keys("commit_hash"), "date", "total_additions", "total_deletions", "total_additions_dot",
                            "total_deletions_dot", "is_fix")
    return window_join(c, "date", w, "prev_date", "rel_date", how=how, on=t.scope)


def _top_pairs(t: Tables, value, name: str, n: int) -> DataFrame:
    j = _commits_in_releases(t, "inner", first=False)
    g = j.groupBy(F.col("prev_tag").alias("tag_name1"), F.col("prev_repo").alias("repo_name1"),
                  F.col("tag_name").alias("tag_name2"), F.col("repo_name").alias("repo_name2")).agg(value.alias(name))
    return top(g, n, F.desc(name), F.asc("tag_name1"), F.asc("repo_name1"), scope=[f"{c}1" for c in t.scope])


@register("release_churn_top")
def release_churn_top(t: Tables, n: int = 10) -> DataFrame:
    """Consecutive release pairs by churn, top 10."""
    return _top_pairs(t, F.sum(churn()), "churn", n)


@register("release_churn_nodot_top")
def release_churn_nodot_top(t: Tables, n: int = 10) -> DataFrame:
    """S3: S2 without dot-file churn."""
    v = F.sum(churn()) - F.sum(churn("total_additions_dot", "total_deletions_dot"))
    return _top_pairs(t, v, "churn", n)


@register("release_commit_count_top")
def release_commit_count_top(t: Tables, n: int = 10) -> DataFrame:
    """Consecutive release pairs by commit count, top 10."""
    return _top_pairs(t, F.count("commit_hash"), "commit_count", n)


def _per_release(t: Tables) -> DataFrame:
    j = _commits_in_releases(t, "left", first=True)
    return j.groupBy("repo_name", "tag_name", "rel_date").agg(
        F.count("commit_hash").alias("commits"),
        F.coalesce(F.sum(churn()), F.lit(0)).cast("long").alias("churn"),
        F.count_if(F.coalesce("is_fix", F.lit(False))).alias("bug_fix_commits"))


@register("release_commits")
def release_commits(t: Tables) -> DataFrame:
    """Commits per release, the first release included."""
    return _per_release(t).select("repo_name", "tag_name", iso("rel_date").alias("release_date"), "commits")


@register("release_churn")
def release_churn(t: Tables) -> DataFrame:
    """Churn per release, the first release included."""
    return _per_release(t).select("repo_name", "tag_name", iso("rel_date").alias("release_date"), "churn")


@register("time_between_releases")
def time_between_releases(t: Tables) -> DataFrame:
    """Days since the previous release (NULL for the first)."""
    w = release_windows(t)
    return w.select("repo_name", "tag_name", "prev_repo", "prev_tag", iso("rel_date").alias("release_date"),
                    rdays(days_between("rel_date", "prev_date")).alias("days_since_previous"))


@register("release_bug_fixes")
def release_bug_fixes(t: Tables) -> DataFrame:
    """Fix commits per release."""
    p = _per_release(t)
    return p.select("repo_name", "tag_name", "commits", "bug_fix_commits",
                    r6(ratio("bug_fix_commits", "commits")).alias("bug_fix_share"))


@register("deployment_frequency")
def deployment_frequency(t: Tables) -> DataFrame:
    """Releases per month."""
    w = release_windows(t)
    return w.groupBy(*t.scope, month("rel_date").alias("month")).agg(F.count(F.lit(1)).alias("releases"))


@register("lead_time")
def lead_time(t: Tables) -> DataFrame:
    """For each commit, time to the first release at or after it (a
    forward as-of join through the release windows): mean and exact median in
    days, both from one histogram of seconds."""
    from .stats import histogram, quantiles
    j = _commits_in_releases(t, "inner", first=True)
    waits = j.select(*t.scope, (F.unix_seconds("rel_date") - F.unix_seconds("date")).alias("seconds"))
    h = histogram(waits, "seconds", t.scope)
    g = h.groupBy(*t.scope).agg(F.coalesce(F.sum("_cnt"), F.lit(0)).alias("released_commits"),
              (F.sum(F.col("seconds") * F.col("_cnt")) / F.sum("_cnt")).alias("mean"),
              *quantiles(h, "seconds", [0.5], ["median"]))
    return for_each_scope(t, g, ["released_commits"]).select(*t.keys("released_commits"), rdays(F.col("mean") / 86400).alias("mean_lead_days"),
                    rdays(F.col("median") / 86400).alias("median_lead_days"))


def _since_last_release(t: Tables) -> DataFrame:
    last = release_windows(t).groupBy(*t.scope).agg(F.max("rel_date").alias("last_release"))
    return beside(fix_flags(t), last, t.scope).where(F.col("date") > F.col("last_release"))


@register("release_readiness")
def release_readiness(t: Tables) -> DataFrame:
    """Activity since the newest release: commits, churn, fix share and
    test share of changed lines."""
    c = _since_last_release(t)
    g = c.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("commits"), F.coalesce(F.sum(churn()), F.lit(0)).alias("churn"),
              F.count_if("is_fix").alias("bug_fix_commits"),
              F.coalesce(F.sum(churn("total_additions_test", "total_deletions_test")), F.lit(0)).alias("_test"))
    g = for_each_scope(t, g, ["commits", "churn"])
    return g.select(*t.keys("commits"), "churn", r6(ratio("bug_fix_commits", "commits")).alias("bug_fix_share"),
                    r6(ratio("_test", "churn")).alias("test_share"))


@register("release_risky_files")
def release_risky_files(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Files with the most churn since the newest release."""
    c = _since_last_release(t).select("commit_hash", "repo_name", "is_fix")
    fc = t.file_changes.join(c, ["commit_hash", "repo_name"], "inner")
    g = fc.groupBy(*t.scope, "file_path").agg(F.count(F.lit(1)).alias("changes"),
                                   F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
                                   F.count_if("is_fix").alias("fix_changes"))
    return top(g, n, F.desc("churn"), F.asc("file_path"), scope=t.scope)
