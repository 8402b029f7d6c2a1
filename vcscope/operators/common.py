"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.timeops import end_of_day, start_of_day

DEFAULT_TOP_N = 20


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Doubles are reported rounded to 6 decimals."""
    return F.round(c(x).cast("double"), 6)


def rdays(x) -> Column:
    """Durations in days are rounded to 9 decimals: second-resolution spans
    can be exact 7-decimal fractions of a day, where 6-decimal rounding would
    sit on a tie."""
    return F.round(c(x).cast("double"), 9)


def ratio(num, den) -> Column:
    """num / den as double, NULL when den is 0 (SQL division semantics)."""
    return F.try_divide(c(num).cast("double"), c(den).cast("double"))


def module(path="file_path", depth: int = 1) -> Column:
    """Module of a path: its first ``depth`` directory segments, ``(root)``
    for files at the top level."""
    parts = F.split(c(path), "/")
    n_dirs = F.size(parts) - 1
    return F.when(n_dirs <= 0, F.lit("(root)")).otherwise(
        F.array_join(F.slice(parts, 1, F.least(F.lit(depth), n_dirs)), "/"))


def extension(path="file_path") -> Column:
    """Lower-cased extension of the file name ('' if none)."""
    name = F.substring_index(c(path), "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def has_keyword(text, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(c(text)).rlike(vocab.keyword_regex(list(words))), F.lit(False))


def is_bug_fix(text="message") -> Column:
    return has_keyword(text, vocab.BUG_KEYWORDS)


def in_range(df: DataFrame, from_: str | None = None, to: str | None = None,
             column: str = "date") -> DataFrame:
    """Inclusive date range, either side optional; pushed to the scan."""
    if from_ is not None:
        df = df.where(F.col(column) >= start_of_day(from_))
    if to is not None:
        df = df.where(F.col(column) <= end_of_day(to))
    return df


def churn(add="total_additions", dele="total_deletions") -> Column:
    return c(add) + c(dele)


def top(df: DataFrame, n: int | None, *order: Column, scope: Sequence[str] = ()) -> DataFrame:
    """Deterministic top-n (callers pass a unique tie-breaker last), of each
    scope if there is one: a rank limit, of which map tasks keep n rows a scope."""
    if n and scope:
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(
            F.col("_nth") <= n).drop("_nth")
        return df.orderBy(*scope, *order)
    out = df.orderBy(*scope, *order)
    return out.limit(n) if n else out


def for_each_scope(t, g: DataFrame, zeros: Sequence[str] = ()) -> DataFrame:
    """``g`` (one row of each scope that has any) with a row of every scope that has
    commits; ``zeros`` are counts, 0 where there was nothing to count."""
    if not t.scope:
        return g
    out = t.commits.select(*t.scope).distinct().join(g, list(t.scope), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})


def beside(df: DataFrame, totals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``totals``, which has one row, or one of each scope
    (null where a scope has none)."""
    if scope:
        return df.join(totals, list(scope), "left")
    return df.withColumns({x: totals.select(x).scalar() for x in totals.columns})
