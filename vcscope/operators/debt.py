"""Technical-debt and refactoring metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..plans.catalog import register
from ..tables import Tables
from .authors import file_owners
from .bugs import fix_flags
from .common import DEFAULT_TOP_N, has_keyword, top
from .joins import range_sums
from .sequence import segmented_lag


@register("low_ownership_hotspots")
def low_ownership_hotspots(t: Tables, min_changes: int = 10, max_share: float = 0.5,
                           n: int = DEFAULT_TOP_N) -> DataFrame:
    """Often-changed files whose top owner holds under half the lines."""
    stats = t.file_changes.groupBy(*t.scope, "file_path").agg(F.count(F.lit(1)).alias("changes"),
                                                    F.countDistinct("author").alias("authors"))
    own = file_owners(t).select(*t.keys("file_path"), F.col("author").alias("owner"), F.col("share").alias("owner_share"))
    j = stats.join(own, t.keys("file_path")).where((F.col("changes") >= min_changes) & (F.col("owner_share") < max_share))
    return top(j, n, F.desc("changes"), F.asc("file_path"), scope=t.scope)


def file_events(t: Tables) -> DataFrame:
    """One row per (file, commit) with the commit's date, fix flag and the
    file's changed lines in it (a commit may list a path twice)."""
    c = fix_flags(t).select("commit_hash", "repo_name", "date", "is_fix", "message")
    fc = t.file_changes.groupBy("file_path", "commit_hash", "repo_name").agg(
        F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
    return fc.join(c, ["commit_hash", "repo_name"])


@register("quick_fix_areas")
def quick_fix_areas(t: Tables, days: int = 7, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Per file, fix commits that came within ``days`` days of the
    file's previous change. The per-file order is computed in range segments,
    so a file with a huge history is not one task."""
    ev = file_events(t).select(*t.keys("file_path", "commit_hash"), "date", "is_fix")
    lagged = segmented_lag(ev, t.keys("file_path"), ["date", "commit_hash"], "date", (1,), prefix="prev_date")
    gap = F.unix_seconds("date") - F.unix_seconds("prev_date1")
    q = lagged.where(F.col("is_fix") & F.col("prev_date1").isNotNull() & (gap <= days * 86400))
    g = q.groupBy(*t.scope, "file_path").agg(F.count(F.lit(1)).alias("quick_fixes"))
    return top(g, n, F.desc("quick_fixes"), F.asc("file_path"), scope=t.scope)


@register("refactoring_impact")
def refactoring_impact(t: Tables, days: int = 30) -> DataFrame:
    """For each file touched by a refactoring commit, churn and fix
    commits on that file in the ``days`` days before and after it (other
    commits only)."""
    ev = file_events(t).select(*t.keys("file_path", "commit_hash"), F.unix_seconds("date").alias("at"), "lines",
                               F.col("is_fix").cast("long").alias("fix"),
                               has_keyword("message", vocab.REFACTOR_KEYWORDS).alias("refactors"))
    near = range_sums(ev, t.keys("file_path"), "at", days * 86400, {"churn_before": "lines", "fixes_before": "fix"},
                      {"churn_after": "lines", "fixes_after": "fix"})
    return near.where("refactors").select(*t.keys("file_path", "commit_hash"), "churn_before", "churn_after",
                                          "fixes_before", "fixes_after")
