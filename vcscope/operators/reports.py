"""The five fixed reports (R1–R5), each with the optional inclusive date range
(R0). All are hash aggregations over the commits table with pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import day
from ..plans.catalog import register
from ..tables import Tables
from .common import churn, in_range, ratio, rdays

# dates used by the registered ranged variants (exercise R0)
RANGE_FROM, RANGE_TO = "1996-01-01", "1997-12-31"


def report_churn(t: Tables, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Per author, commits and summed deletions and additions."""
    c = in_range(t.commits, from_, to)
    return c.groupBy("author").agg(
        F.count("commit_hash").alias("num_commits"),
        F.sum("total_deletions").alias("total_deletions"),
        F.sum("total_additions").alias("total_additions"),
    )


def report_releases(t: Tables, from_: str | None = None, to: str | None = None) -> DataFrame:
    """R2: tags whose commit exists (and lies in the range). The tag table is
    small next to commits, and the join is on the composite key."""
    c = in_range(t.commits.select("commit_hash", "repo_name", "date"), from_, to)
    tags = t.tags.select("tag_name", F.col("tag_commit").alias("commit_hash"), "repo_name")
    return tags.join(c, ["commit_hash", "repo_name"], "inner").agg(
        F.count("tag_name").alias("no_of_releases"))


def report_merge_time(t: Tables, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Per repository, mean days between consecutive merge commits.

    The mean of consecutive gaps telescopes to (last − first) / (n − 1), so
    this is one partial hash aggregation, no sort and no window. Repositories
    with a single merge have no gap and no row."""
    m = in_range(t.commits.where(F.col("is_merge") == 1), from_, to)
    g = m.groupBy("repo_name").agg(
        F.max("date").alias("_last"), F.min("date").alias("_first"), F.count("date").alias("_n"))
    days = (F.unix_micros("_last") - F.unix_micros("_first")) / F.lit(86_400_000_000.0)
    return g.where(F.col("_n") > 1).select(
        "repo_name", rdays(days / (F.col("_n") - 1)).alias("avg_time_in_days_between_merges"))


def report_commit_velocity(t: Tables, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Commits per repository per UTC day."""
    c = in_range(t.commits, from_, to)
    return (c.groupBy(day("date").alias("day"), "repo_name")
             .agg(F.count("commit_hash").alias("commits_per_day"))
             .orderBy("repo_name", "day"))


def report_test_changes(t: Tables, from_: str | None = None, to: str | None = None) -> DataFrame:
    """Per repository, changed lines, changed test lines and their share."""
    c = in_range(t.commits, from_, to)
    g = c.groupBy("repo_name").agg(
        F.sum(churn()).alias("total_changes"),
        F.sum(churn("total_additions_test", "total_deletions_test")).alias("test_file_changes"))
    pct = F.round(ratio(F.col("test_file_changes") * 100, "total_changes"), 2)
    return g.withColumn("test_file_change_percentage", pct).orderBy(F.desc("test_file_change_percentage"), "repo_name")


REPORTS = {
    "report_churn": report_churn,
    "report_releases": report_releases,
    "report_merge_time": report_merge_time,
    "report_commit_velocity": report_commit_velocity,
    "report_test_changes": report_test_changes,
}

for _name, _fn in REPORTS.items():
    register(_name)(lambda t, _f=_fn: _f(t))
    register(f"{_name}_ranged")(lambda t, _f=_fn: _f(t, RANGE_FROM, RANGE_TO))
