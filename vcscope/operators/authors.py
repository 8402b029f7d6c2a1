"""Author metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import local_time, month, weekday
from ..plans.catalog import register
from ..tables import Tables
from .common import DEFAULT_TOP_N, churn, module, r6, ratio, top
from .stats import running


@register("total_contributors")
def total_contributors(t: Tables) -> DataFrame:
    """Distinct authors."""
    return t.commits.groupBy(*t.scope).agg(F.countDistinct("author").alias("total_contributors"))


def _author_totals(t: Tables) -> DataFrame:
    return t.commits.groupBy(*t.scope, "author").agg(F.count(F.lit(1)).alias("commits"), F.sum(churn()).alias("lines_changed"))


@register("top_contributors_by_commits")
def top_contributors_by_commits(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """M11."""
    return top(_author_totals(t), n, F.desc("commits"), F.asc("author"), scope=t.scope)


@register("top_contributors_by_lines")
def top_contributors_by_lines(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """M11."""
    return top(_author_totals(t), n, F.desc("lines_changed"), F.asc("author"), scope=t.scope)


def ownership(t: Tables, by: str = "file", depth: int = 1) -> DataFrame:
    """Share of changed lines per author within each file (or module);
    the owner has rank 1 (most lines, author name breaks ties). Ranks and unit
    totals are running sums over ranges of (unit, author) totals, so a unit with
    most of the authors is spread over tasks."""
    unit = F.col("file_path") if by == "file" else module("file_path", depth)
    per = (t.file_changes.groupBy(*t.scope, unit.alias("unit"), "author")
           .agg(F.sum(F.col("additions") + F.col("deletions")).alias("lines")))
    r = running(per.withColumn("_one", F.lit(1)), t.keys("unit"), [F.desc("lines"), F.asc("author")],
                {"owner_rank": "_one", "unit_lines": "lines"})
    return r.select(*t.keys("unit"), "author", "lines", F.col("unit_lines_all").alias("unit_lines"),
                    r6(ratio("lines", "unit_lines_all")).alias("share"), F.col("owner_rank").cast("int").alias("owner_rank"))


def file_owners(t: Tables) -> DataFrame:
    """file_path, author (the owner), lines, file_lines, share: the author of most
    lines of each file (name breaks ties), without ordering a file's authors."""
    per = t.file_changes.groupBy(*t.scope, "file_path", "author").agg(
        F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
    g = per.groupBy(*t.scope, "file_path").agg(
        F.min(F.struct((-F.col("lines")).alias("less"), F.col("author"))).alias("o"), F.sum("lines").alias("file_lines"))
    lines = -F.col("o.less")
    return g.select(*t.keys("file_path"), "o.author", lines.alias("lines"), "file_lines",
                    r6(ratio(lines, "file_lines")).alias("share"))


@register("code_ownership_files")
def code_ownership_files(t: Tables) -> DataFrame:
    """Every file's top owner and share."""
    return file_owners(t).select(*t.keys("file_path"), F.col("author").alias("owner"), "lines", "file_lines",
                                 F.col("share").alias("owner_share"))


@register("code_ownership_modules")
def code_ownership_modules(t: Tables, depth: int = 1) -> DataFrame:
    """Share of every author in every module."""
    o = ownership(t, "module", depth)
    return o.select(*t.scope, F.col("unit").alias("module"), "author", "lines", "share", "owner_rank")


@register("developer_churn")
def developer_churn(t: Tables) -> DataFrame:
    """Per month, authors whose first commit (joined) and last commit
    (left) fall in it."""
    span = t.commits.groupBy(*t.scope, "author").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    joined = span.groupBy(*t.scope, month("first").alias("month")).agg(F.count(F.lit(1)).alias("authors_joined"))
    left = span.groupBy(*t.scope, month("last").alias("month")).agg(F.count(F.lit(1)).alias("authors_left"))
    return (joined.join(left, t.keys("month"), "full")
            .select(*t.keys("month"), F.coalesce("authors_joined", F.lit(0)).alias("authors_joined"),
                    F.coalesce("authors_left", F.lit(0)).alias("authors_left")))


@register("activity_patterns")
def activity_patterns(t: Tables) -> DataFrame:
    """Commits by weekday (0 = Sunday) and hour, on the UTC clock and on
    the author's local clock."""
    c = t.commits.select(*t.scope, "date", "timezone")
    utc = c.select(*t.scope, F.lit("utc").alias("clock"), weekday("date").alias("weekday"), F.hour("date").alias("hour"))
    loc = c.select(*t.scope, local_time("date", "timezone").alias("lt")).select(
        *t.scope, F.lit("local").alias("clock"), weekday("lt").alias("weekday"), F.hour("lt").alias("hour"))
    return utc.unionByName(loc).groupBy(*t.scope, "clock", "weekday", "hour").agg(F.count(F.lit(1)).alias("commits"))


@register("after_hours_share")
def after_hours_share(t: Tables, start_hour: int = 9, end_hour: int = 18) -> DataFrame:
    """Per author, share of commits outside working hours or on a
    weekend, on the author's local clock."""
    lt = local_time("date", "timezone")
    off = (F.hour(lt) < start_hour) | (F.hour(lt) >= end_hour) | weekday(lt).isin(0, 6)
    g = t.commits.groupBy(*t.scope, "author").agg(F.count(F.lit(1)).alias("commits"),
                                        F.count_if(off).alias("after_hours_commits"))
    return g.withColumn("after_hours_share", r6(ratio("after_hours_commits", "commits")))


@register("changes_per_commit_by_author")
def changes_per_commit_by_author(t: Tables) -> DataFrame:
    """Changed lines per commit by author (named bus factor in the
    prompt); the file totals are left-joined, so authors of merges only keep a
    row with NULL changes."""
    cc = t.commits.groupBy(*t.scope, "author").agg(F.count("commit_hash").alias("total_commits"))
    fc = t.file_changes.groupBy(*t.scope, "author").agg(F.sum(F.col("additions") + F.col("deletions")).alias("total_changes"))
    j = cc.join(fc, t.keys("author"), "left")
    bf = F.when(F.col("total_commits") > 0,
                F.round(ratio("total_changes", "total_commits"), 2)).otherwise(F.lit(0.0))
    return j.select(*t.keys("author"), "total_commits", "total_changes", bf.alias("bus_factor")).orderBy(
        *t.scope, F.desc("bus_factor"), "author")
