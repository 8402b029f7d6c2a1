"""Exact order statistics without gathering raw rows in one task.

Quantiles and percent ranks need a global order. Instead of sorting all rows
in one partition, rows are first reduced to a histogram (value → count, a
partial hash aggregation), whose distinct values are summed range by range.
The same running sums, of each key of several, rank the members of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name → column of ``sums``, the sum of the column up to this
    row within its key in ``order`` (total within a key), and ``{name}_all``, its
    sum over the key. A row number is the running sum of ones.

    No key is one task: rows are put into ranges of (key, order), each (key, range)
    sums its own rows, and the sums of a key's ranges (as many rows as keys and
    partitions together) give what comes before. The ranges are checkpointed,
    because their bounds come from a sample."""
    spark, keys = df.sparkSession, list(keys)
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    own = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    # A key's ranges in a row, each with the sums of those before it.
    names = list(sums)
    fields = ", ".join(f"'{x}', CAST(0 AS bigint)" for x in names)
    before = ", ".join(f"'{x}', a.at.{x}" for x in names)
    grown = ", ".join(f"'{x}', a.at.{x} + r._s_{x}" for x in names)
    seen = ", ".join(f"{x}: bigint" for x in names)
    walk = F.expr(f"""aggregate(array_sort(_ranges),
        named_struct('at', named_struct({fields}), 'out', CAST(array() AS array<struct<_part: int, _before: struct<{seen}>>>)),
        (a, r) -> named_struct('at', named_struct({grown}), 'out', array_append(a.out,
            named_struct('_part', r._part, '_before', named_struct({before})))))""")
    totals = own.groupBy(*keys).agg(F.collect_list(F.struct("_part", *[f"_s_{x}" for x in names])).alias("_ranges"))
    totals = totals.select(*keys, walk.alias("_w")).select(
        *keys, *[F.col(f"_w.at.{x}").alias(f"{x}_all") for x in names], F.explode("_w.out").alias("_r"))
    totals = totals.select(*keys, F.col("_r._part").alias("_part"), F.col("_r._before").alias("_before"),
                           *[f"{x}_all" for x in names])
    w = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = parts.withColumns({x: F.sum(c).over(w) for x, c in sums.items()})
    return within.join(totals, [*keys, "_part"]).withColumns(
        {x: F.col(x) + F.col(f"_before.{x}") for x in names}).drop("_part", "_before")


def running_sum(df: DataFrame, order: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_cum`` (sum of ``amount`` up to this row in ``order``, whose values
    are distinct within ``by``) and ``_n`` (sum of all)."""
    return running(df, by, [order], {"_cum": amount}).withColumnRenamed("_cum_all", "_n")


def dense_numbers(df: DataFrame, col: str) -> DataFrame:
    """``col`` (distinct values) and ``no``: 0, 1, … in their order."""
    s = running_sum(df.select(col, F.lit(1).cast("long").alias("_one")), col, "_one")
    return s.select(col, (F.col("_cum") - 1).alias("no"))


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, value, _cnt, _cum (rows <= value), _n (all rows); nulls dropped."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    return running_sum(h, value, "_cnt", by)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregate expressions (over the histogram returned by ``histogram``)
    for linearly interpolated quantiles, equal to ``quantile_cont``."""
    out = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        v_lo = F.min(F.when(F.col("_cum") > lo, F.col(value)))
        v_hi = F.min(F.when(F.col("_cum") > hi, F.col(value)))
        frac = F.first(pos - lo)
        out.append(F.round((v_lo + frac * (v_hi - v_lo)).cast("double"), 6).alias(name))
    return out


def at_values(df: DataFrame, h: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``h``, which has one row and the count ``_cnt`` for
    each ``on`` (null where it has none).

    A value that many rows share would be one task. Values with more than a
    partition's share of all rows (fewer than there are partitions) are
    broadcast with the number of shares they have; their rows are dealt into so
    many salts, and their row of ``h`` is repeated for each."""
    on, n = list(on), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = h.select(F.sum("_cnt")).scalar()
    h = h.withColumn("_copies", F.ceil(F.col("_cnt") * n / rows))
    hot = h.where("_copies > 1").select(*on, F.col("_copies").alias("_salts"))
    # Rows without a value meet nothing and are dealt at large.
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    salts = F.when(none, F.lit(n)).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = df.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns), salts).cast("int")).drop("_salts")
    copies = h.withColumn("_salt", F.explode(F.expr("sequence(0, CAST(_copies AS int) - 1)"))).drop("_copies", "_cnt")
    return dealt.join(copies, [*on, "_salt"], "left").drop("_salt")


def percent_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = percent_rank() over (partition by ``by`` order by value) for
    every row: (rows with a smaller value) / (rows − 1), 0 for a single row."""
    h = histogram(df, value, by)
    pr = F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise((F.col("_cum") - F.col("_cnt")) / (F.col("_n") - 1))
    h = h.select(*by, value, "_cnt", pr.alias(out))
    return at_values(df, h, [*by, value]).withColumn(out, F.coalesce(out, F.lit(0.0)))


def mean_percent_rank(df: DataFrame, key: str, values: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """``key`` (one row each within ``by``) and ``out``: the mean of the percent
    ranks of ``values`` (none null). All columns share one histogram, in which a
    column follows the other."""
    by = list(by)
    each = df.select(*by, key, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_f", "_v"))
    h = each.groupBy(*by, F.struct("_f", "_v").alias("_fv")).agg(F.count(F.lit(1)).alias("_cnt"))
    h = running_sum(h, "_fv", "_cnt", by)
    rows = F.col("_n") / len(values)
    less = F.col("_cum") - F.col("_cnt") - F.col("_fv._f") * rows
    h = h.select(*by, F.col("_fv._f").alias("_f"), F.col("_fv._v").alias("_v"), "_cnt",
                 F.when(rows <= 1, F.lit(0.0)).otherwise(less / (rows - 1)).alias("_pr"))
    return at_values(each, h, [*by, "_f", "_v"]).groupBy(*by, key).agg((F.sum("_pr") / len(values)).alias(out))


def rank_desc(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = rank() over (partition by ``by`` order by value desc): 1 +
    rows with a larger value."""
    h = histogram(df, value, by).select(*by, value, "_cnt", (F.col("_n") - F.col("_cum") + 1).alias(out))
    return at_values(df, h, [*by, value])
