"""Bug metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import month
from ..plans.catalog import register
from ..session import staged
from ..tables import Tables
from .authors import file_owners
from .common import DEFAULT_TOP_N, beside, is_bug_fix, module, r6, ratio, top
from .stats import mean_percent_rank


def fix_flags(t: Tables) -> DataFrame:
    """Commits with ``is_fix``: a bug keyword in the message, or in the
    message of a tag on the commit. Tag hits are de-duplicated per commit
    before the join, so the join cannot multiply commits."""
    tag_hits = (t.tags.where(is_bug_fix("tag_message"))
                .select(F.col("tag_commit").alias("commit_hash"), "repo_name").distinct()
                .withColumn("_tag_fix", F.lit(True)))
    c = t.commits.join(tag_hits, ["commit_hash", "repo_name"], "left")
    return c.withColumn("is_fix", is_bug_fix("message") | F.coalesce("_tag_fix", F.lit(False))).drop("_tag_fix")


def fix_commits(t: Tables) -> DataFrame:
    return fix_flags(t).where("is_fix").select("commit_hash", "repo_name")


def fix_changes(t: Tables) -> DataFrame:
    """File changes of fix commits (left-semi join: no duplication)."""
    return t.file_changes.join(fix_commits(t), ["commit_hash", "repo_name"], "left_semi")


@register("bug_fix_commits")
def bug_fix_commits(t: Tables) -> DataFrame:
    """Number and share of bug-fix commits."""
    return fix_flags(t).groupBy(*t.scope).agg(F.count(F.lit(1)).alias("total_commits"),
                            F.count_if("is_fix").alias("bug_fix_commits")).withColumn(
        "bug_fix_share", r6(ratio("bug_fix_commits", "total_commits")))


@register("bug_fix_frequency")
def bug_fix_frequency(t: Tables) -> DataFrame:
    """Bug-fix commits per month."""
    g = fix_flags(t).groupBy(*t.scope, month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if("is_fix").alias("bug_fix_commits"))
    return g.withColumn("bug_fix_share", r6(ratio("bug_fix_commits", "commits")))


@register("bug_fix_files")
def bug_fix_files(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Files touched by the most fix commits."""
    g = fix_changes(t).groupBy(*t.scope, "file_path").agg(F.countDistinct("repo_name", "commit_hash").alias("fix_commits"))
    return top(g, n, F.desc("fix_commits"), F.asc("file_path"), scope=t.scope)


@register("bug_fix_modules")
def bug_fix_modules(t: Tables, n: int = DEFAULT_TOP_N, depth: int = 1) -> DataFrame:
    """Modules touched by the most fix commits."""
    g = (fix_changes(t).groupBy(*t.scope, module("file_path", depth).alias("module"))
         .agg(F.countDistinct("repo_name", "commit_hash").alias("fix_commits")))
    return top(g, n, F.desc("fix_commits"), F.asc("module"), scope=t.scope)


def _file_fix_counts(t: Tables) -> DataFrame:
    return fix_changes(t).groupBy(*t.scope, "file_path").agg(F.countDistinct("repo_name", "commit_hash").alias("fixes"))


@register("churn_bug_correlation")
def churn_bug_correlation(t: Tables) -> DataFrame:
    """Pearson correlation over files of churn and fix commits."""
    ch = t.file_changes.groupBy(*t.scope, "file_path").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
    j = ch.join(_file_fix_counts(t), t.keys("file_path"), "left").withColumn("fixes", F.coalesce("fixes", F.lit(0)))
    return j.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("files"), r6(F.corr("churn", "fixes")).alias("correlation"))


@register("defect_risk")
def defect_risk(t: Tables, cut: float = 0.7, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Per file, activity before a cut date (changes, churn, authors)
    ranked against all files (mean percent rank = risk score), beside the fix
    commits after the cut. The cut lies at ``cut`` of the commit time span."""
    at = F.unix_micros("date")
    bounds = t.commits.groupBy(*t.scope).agg((F.min(at) + F.lit(cut) * (F.max(at) - F.min(at))).alias("cut_us"))
    c = beside(fix_flags(t), bounds, t.scope).select("commit_hash", "repo_name", "is_fix",
                                                     (at <= F.col("cut_us")).alias("early"))
    lines = F.col("additions") + F.col("deletions")
    fc = t.file_changes.select("commit_hash", "repo_name", "file_path", "author", lines.alias("lines")).join(
        c, ["commit_hash", "repo_name"]).where("early OR is_fix")
    # One row of a commit's file and early author, so that nothing is told apart after the
    # shuffle but the authors of a file.
    who = F.when(F.col("early"), F.col("author")).alias("who")
    per = fc.groupBy("commit_hash", "repo_name", "file_path", "early", who).agg(
        F.count_if("early").alias("changes"), F.sum(F.when(F.col("early"), F.col("lines"))).alias("churn"))
    by_author = per.groupBy(*t.scope, "file_path", "who").agg(
        F.sum("changes").alias("changes"), F.sum("churn").alias("churn"), F.count_if(~F.col("early")).alias("fixes"))
    files = by_author.groupBy(*t.scope, "file_path").agg(
        F.sum("changes").alias("changes_before"), F.sum("churn").alias("churn_before"),
        F.count("who").alias("authors_before"), F.sum("fixes").alias("fixes_after"))
    # Numbers of the written files stand for their paths.
    files = staged(files.where("changes_before > 0").withColumn("_no", F.monotonically_increasing_id()), "defect-risk")
    rank = mean_percent_rank(files, "_no", ["changes_before", "churn_before", "authors_before"], "risk", t.scope)
    r = files.dropna(subset=["file_path"]).join(rank, t.keys("_no")).select(*t.keys("file_path"), "changes_before", "churn_before", "authors_before",
                                             r6("risk").alias("risk_score"), "fixes_after")
    return top(r, n, F.desc("risk_score"), F.asc("file_path"), scope=t.scope)


@register("bug_fix_authors")
def bug_fix_authors(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Authors with the most fix commits."""
    g = fix_flags(t).groupBy(*t.scope, "author").agg(F.count_if("is_fix").alias("fix_commits"),
                                           F.count(F.lit(1)).alias("commits"))
    g = g.withColumn("fix_share", r6(ratio("fix_commits", "commits")))
    return top(g, n, F.desc("fix_commits"), F.asc("author"), scope=t.scope)


@register("ownership_vs_bugs")
def ownership_vs_bugs(t: Tables) -> DataFrame:
    """Correlation over files of the top owner's share and fixes."""
    own = file_owners(t).select(*t.keys("file_path"), "share")
    j = own.join(_file_fix_counts(t), t.keys("file_path"), "left").withColumn("fixes", F.coalesce("fixes", F.lit(0)))
    return j.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("files"), r6(F.corr("share", "fixes")).alias("correlation"))
