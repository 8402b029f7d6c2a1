"""Commit metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import days_between, iso, period
from ..plans.catalog import register
from ..tables import Tables
from .common import DEFAULT_TOP_N, beside, churn, module, r6, ratio, rdays, top
from .sequence import segmented_lag
from .stats import histogram, quantiles


@register("time_between_commits")
def time_between_commits(t: Tables) -> DataFrame:
    """Per commit, days since the previous commit in global date order
    (hash breaks ties); the first commit has no row. The global order is
    computed in range segments, not in one partition."""
    c = t.commits.select(*t.scope, "commit_hash", "date")
    lagged = segmented_lag(c, t.scope, ["date", "commit_hash"], "date", (1,), prefix="prev_date")
    return lagged.where(F.col("prev_date1").isNotNull()).select(
        *t.scope, "commit_hash", iso("date").alias("date"),
        rdays(days_between("date", "prev_date1")).alias("time_since_last_commit"))


@register("total_commits")
def total_commits(t: Tables) -> DataFrame:
    """M01."""
    return t.commits.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("total_commits"))


def commit_frequency(t: Tables, unit: str = "month") -> DataFrame:
    """Commits per day, week (Monday start) or month."""
    return t.commits.groupBy(*t.scope, period("date", unit).alias("period")).agg(F.count(F.lit(1)).alias("commits"))


register("commit_frequency_daily")(lambda t: commit_frequency(t, "day"))
register("commit_frequency_weekly")(lambda t: commit_frequency(t, "week"))
register("commit_frequency_monthly")(lambda t: commit_frequency(t, "month"))


@register("avg_time_between_commits")
def avg_time_between_commits(t: Tables) -> DataFrame:
    """Mean gap between consecutive commits = (last − first) / (n − 1)."""
    g = t.commits.groupBy(*t.scope).agg(F.max("date").alias("_l"), F.min("date").alias("_f"), F.count("date").alias("_n"))
    return g.select(*t.scope, rdays(ratio(days_between("_l", "_f"), F.col("_n") - 1)).alias("avg_days_between_commits"))


@register("commits_per_author")
def commits_per_author(t: Tables) -> DataFrame:
    """M04."""
    return t.commits.groupBy(*t.scope, "author").agg(F.count(F.lit(1)).alias("commits"))


@register("commits_per_file")
def commits_per_file(t: Tables) -> DataFrame:
    """Distinct commits that touched each path."""
    return t.file_changes.groupBy(*t.scope, "file_path").agg(F.countDistinct("repo_name", "commit_hash").alias("commits"))


@register("commits_per_module")
def commits_per_module(t: Tables, depth: int = 1) -> DataFrame:
    """Distinct commits per module (first ``depth`` directories)."""
    fc = t.file_changes.select(module("file_path", depth).alias("module"), "repo_name", "commit_hash")
    return fc.groupBy(*t.scope, "module").agg(F.countDistinct("repo_name", "commit_hash").alias("commits"))


@register("commit_size_distribution")
def commit_size_distribution(t: Tables) -> DataFrame:
    """Changed lines per commit — min, quartiles, p95, max, mean (exact,
    linear interpolation) from a histogram of sizes."""
    sizes = t.commits.select(*t.scope, churn().alias("lines"))
    h = histogram(sizes, "lines", t.scope)
    qs = quantiles(h, "lines", [0.25, 0.5, 0.75, 0.95], ["p25_lines", "p50_lines", "p75_lines", "p95_lines"])
    return h.groupBy(*t.scope).agg(
        F.sum("_cnt").alias("commits"),
        F.min("lines").alias("min_lines"),
        *qs,
        F.max("lines").alias("max_lines"),
        r6(F.sum(F.col("lines") * F.col("_cnt")) / F.sum("_cnt")).alias("mean_lines"),
    )


# size classes of the distribution (upper bound inclusive)
SIZE_BUCKETS = [(0, "0"), (10, "1-10"), (100, "11-100"), (1000, "101-1000")]


@register("commit_size_buckets")
def commit_size_buckets(t: Tables) -> DataFrame:
    """Commits per size class of changed lines."""
    lines = churn()
    b = F.lit(">1000")
    for bound, label in reversed(SIZE_BUCKETS):
        b = F.when(lines <= bound, F.lit(label)).otherwise(b)
    return t.commits.groupBy(*t.scope, b.alias("size_bucket")).agg(F.count(F.lit(1)).alias("commits"))


@register("large_commits")
def large_commits(t: Tables, k: float = 2.0, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Commits whose churn exceeds mean + k standard deviations."""
    c = t.commits.withColumn("churn", churn())
    bound = c.groupBy(*t.scope).agg((F.avg("churn") + F.lit(k) * F.stddev_pop("churn")).alias("bound"))
    big = beside(c, bound, t.scope).where(F.col("churn") > F.col("bound")).select("commit_hash", "repo_name", "author", iso("date").alias("date"),
                                                 "churn")
    return top(big, n, F.desc("churn"), F.asc("commit_hash"), scope=t.scope)


@register("avg_commit_size")
def avg_commit_size(t: Tables) -> DataFrame:
    """Mean distinct files and mean changed lines per commit; commits
    without file changes (merges) count as zero files."""
    files = t.file_changes.groupBy(*t.scope).agg(F.countDistinct("repo_name", "commit_hash", "file_path").alias("files"))
    g = t.commits.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("commits"), F.avg(churn()).alias("lines"))
    return beside(g, files, t.scope).select(
        *t.scope, r6(ratio(F.coalesce("files", F.lit(0)), "commits")).alias("avg_files_per_commit"),
        r6("lines").alias("avg_lines_per_commit"))
