"""Productivity metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.timeops import month, week
from ..plans.catalog import register
from ..tables import Tables
from .common import DEFAULT_TOP_N, churn, has_keyword, r6, ratio, top
from .stats import percent_rank, rank_desc


def _monthly(t: Tables) -> DataFrame:
    maint = has_keyword("message", vocab.BUG_KEYWORDS + vocab.IMPROVEMENT_KEYWORDS)
    return t.commits.groupBy(*t.scope, month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("commits"),
        F.countDistinct("author").alias("active_authors"),
        F.count_if(maint).alias("maintenance_commits"),
        F.sum(churn()).alias("churn"))


@register("commits_per_author_over_time")
def commits_per_author_over_time(t: Tables) -> DataFrame:
    """Per month, commits, active authors and commits per author."""
    m = _monthly(t)
    return m.select(*t.keys("month"), "commits", "active_authors",
                    r6(ratio("commits", "active_authors")).alias("commits_per_author"))


@register("most_active_months")
def most_active_months(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """M36."""
    g = t.commits.groupBy(*t.scope, month("date").alias("month")).agg(F.count(F.lit(1)).alias("commits"))
    return top(g, n, F.desc("commits"), F.asc("month"), scope=t.scope)


@register("most_active_weeks")
def most_active_weeks(t: Tables, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Weeks start on Monday."""
    g = t.commits.groupBy(*t.scope, week("date").alias("week")).agg(F.count(F.lit(1)).alias("commits"))
    return top(g, n, F.desc("commits"), F.asc("week"), scope=t.scope)


def productivity_comparison(t: Tables, teams: DataFrame | None = None) -> DataFrame:
    """Authors (or teams, through an optional author → team table) by
    commits and churn, with rank by commits and percent rank by churn. Ranks
    come from value histograms, not from a window over all rows."""
    c = t.commits.select(*t.keys("author", "commit_hash"), churn().alias("lines"))
    unit = "author"
    if teams is not None:
        own = [x for x in t.scope if x in teams.columns]  # a list may be of each scope
        c = c.join(teams.select(*own, "author", "team"), [*own, "author"], "left").withColumn(
            "team", F.coalesce("team", F.lit("(none)")))
        unit = "team"
    g = c.groupBy(*t.scope, unit).agg(F.count(F.lit(1)).alias("commits"), F.sum("lines").alias("churn"))
    g = rank_desc(g, "commits", "commit_rank", t.scope)
    g = percent_rank(g, "churn", "churn_percent_rank", t.scope)
    return g.select(*t.keys(unit), "commits", "churn", "commit_rank", r6("churn_percent_rank").alias("churn_percent_rank"))


register("productivity_comparison")(lambda t: productivity_comparison(t))


def home_offsets(t: Tables) -> DataFrame:
    """author, team: the UTC offset of most of an author's commits (the last in
    order of several), for where no list of teams is given."""
    per = t.commits.groupBy(*t.scope, "author", "timezone").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", F.col("timezone"))).alias("m")
    return per.groupBy(*t.scope, "author").agg(most).select(*t.keys("author"), F.col("m.timezone").alias("team"))


@register("productivity_by_team")
def productivity_by_team(t: Tables) -> DataFrame:
    """Teams, here of authors of one home offset, compared."""
    return productivity_comparison(t, home_offsets(t))


@register("feature_vs_maintenance")
def feature_vs_maintenance(t: Tables) -> DataFrame:
    """Per month, maintenance commits (bug-fix or improvement words)
    against feature commits (the rest)."""
    m = _monthly(t)
    return m.select(*t.keys("month"), "commits", "maintenance_commits",
                    (F.col("commits") - F.col("maintenance_commits")).alias("feature_commits"),
                    r6(ratio("maintenance_commits", "commits")).alias("maintenance_share"))


@register("maintenance_vs_velocity")
def maintenance_vs_velocity(t: Tables) -> DataFrame:
    """Correlation over months of maintenance share and commit count."""
    m = _monthly(t).withColumn("share", ratio("maintenance_commits", "commits"))
    return m.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("months"), r6(F.corr("share", "commits")).alias("correlation"))


@register("team_size_impact")
def team_size_impact(t: Tables) -> DataFrame:
    """Correlation over months of active authors and commits per author."""
    m = _monthly(t).withColumn("cpa", ratio("commits", "active_authors"))
    return m.groupBy(*t.scope).agg(F.count(F.lit(1)).alias("months"), r6(F.corr("active_authors", "cpa")).alias("correlation"))


@register("trend_forecast")
def trend_forecast(t: Tables) -> DataFrame:
    """Least-squares line over monthly commits and churn (x = month
    index), and the value it gives for the month after the last."""
    m = _monthly(t).withColumn(
        "x", (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int") - 1).cast("double"))
    rows = []
    for metric in ("commits", "churn"):
        y = F.col(metric).cast("double")
        rows.append(m.groupBy(*t.scope).agg(F.lit(metric).alias("metric"), F.regr_slope(y, "x").alias("slope"),
                          F.regr_intercept(y, "x").alias("intercept"), (F.max("x") + 1).alias("nx")))
    r = rows[0].unionByName(rows[1])
    nx = F.col("nx").cast("int")
    next_month = F.format_string("%04d-%02d", F.floor(nx / 12).cast("int"), (nx % 12) + 1)
    return r.select(*t.keys("metric"), r6("slope").alias("slope"), r6("intercept").alias("intercept"),
                    next_month.alias("next_month"),
                    r6(F.col("intercept") + F.col("slope") * F.col("nx")).alias("forecast"))
