"""Join shapes Spark has no single operator for, written as equi-joins.

* ``substring_join``: right.pattern occurs in left.text (theta join on
  ``instr``) as an exact equi-join on one gram of each pattern.
* ``window_join``: rows of a fact table that fall in half-open time windows
  (releases), as an equi-join on a time bucket plus a residual range test.
* ``range_sums``: sums over the events of a key shortly before or after each.
* ``interval_pairs``: pairs of events on one key whose times are at most a gap
  apart, as an equi-join on (key, bucket) with the neighbour bucket exploded and
  large buckets dealt into pairs of blocks.

None of them uses a cartesian or nested-loop join, so each scales with the
data, and a hot key is spread by its buckets or candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .stats import at_values

MICROS_PER_SECOND = 1_000_000
# Patterns are looked up by one gram of this many characters each.
GRAM = 8
# Hashes of grams, 64 to a word of a map.
GRAM_HASHES = 1 << 26


def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters of a text (none if it is shorter)."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(starts, lambda p: F.substring(text, p, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def _possible(grams: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``grams`` whose hash one of ``lookup`` has."""
    slot = F.pmod(F.xxhash64(*on, "_gram"), F.lit(GRAM_HASHES)).alias("_slot")
    bit = F.expr("shiftleft(1L, CAST(_slot % 64 AS int))")
    words = lookup.select(slot).select(F.shiftright("_slot", 6).alias("_in"), bit.alias("_bit")).groupBy("_in").agg(
        F.bit_or("_bit").alias("_bits"))  # at most GRAM_HASHES / 64 rows
    has = (F.shiftright("_slot", 6) == F.col("_in")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return grams.select("*", slot).join(F.broadcast(words), has, "left_semi").drop("_slot")


def substring_join(left: DataFrame, text_col: str, right: DataFrame, pattern_col: str,
                   on: Sequence[str], left_key: Sequence[str]) -> DataFrame:
    """All (left, right) row pairs with equal ``on`` keys where
    ``instr(left.text, right.pattern) > 0``; ``left_key`` (with ``on``)
    identifies a left row. Empty patterns match nothing.

    Each pattern is known by its rarest gram among all patterns, so that a start
    many share (``feature/``) selects nothing. A text's grams equi-join these:
    only keys move, work is linear in the text's length, and texts are compared
    with the patterns found. Patterns shorter than a gram are a gram themselves.

    Grams whose hash no pattern's gram has are left out where the text is read: a map of
    GRAM_HASHES bits says so, so it is bounded whatever the number of patterns, and sparse
    for millions of them. Only those that can match are shuffled, and none where the
    patterns fit a broadcast."""
    on, left_key = list(on), list(left_key)
    names = right.select(*on, F.col(pattern_col).alias("_pattern")).where("length(_pattern) > 0").distinct()
    parts = names.select(*on, "_pattern", F.explode(F.array_distinct(
        _grams(F.col("_pattern"), GRAM))).alias("_gram"))
    common = parts.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    anchored = parts.join(common, [*on, "_gram"]).groupBy(*on, "_pattern").agg(
        F.min(F.struct("_n", "_gram")).alias("_a")).select(*on, "_pattern", F.col("_a._gram").alias("_gram"))
    short = names.where(F.length("_pattern") < GRAM).withColumn("_gram", F.col("_pattern"))
    # Written, so that its size is known when the join is planned.
    lookup = staged(anchored.unionByName(short), "name-grams")
    # At most GRAM - 1 lengths.
    lengths = [r[0] for r in short.select(F.length("_pattern")).distinct().collect()]
    text = F.col(text_col)
    keys = F.array_distinct(F.concat(*[_grams(text, n) for n in [GRAM, *lengths]]))
    grams = _possible(left.select(*on, *left_key, F.explode(keys).alias("_gram")), lookup, on)
    found = grams.join(lookup, [*on, "_gram"]).select(*on, *left_key, "_pattern").distinct()
    hits = left.join(found, [*on, *left_key]).where(F.instr(text, F.col("_pattern")) > 0)
    return hits.join(right.withColumn("_pattern", F.col(pattern_col)), [*on, "_pattern"]).drop("_pattern")


def time_bucket(ts: Column | str, width_seconds: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c) / F.lit(width_seconds)).cast("long")


# Rows of a side that meet as many of the other in one key of a blocked join.
BLOCK = 2048


def interval_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
                   max_gap_seconds: int, forward_only: bool = False, block: int = BLOCK) -> DataFrame:
    """Pairs with equal ``on`` keys and |right_ts - left_ts| <= gap (or
    0 <= right_ts - left_ts <= gap when ``forward_only``).

    Both sides are bucketed by ``gap``; the right side is matched against the
    left bucket and its neighbours, so a key's rows are split by time and the
    join is an equi-join on (key, bucket). Where a (key, bucket) has more rows than
    a block, either side is dealt into blocks and every pair of blocks is a key of
    its own: a busy key's pairs are spread, each row being sent once to each block
    of the other side."""
    on = list(on)
    lb = left.withColumn("_ij_b", time_bucket(left_ts, max_gap_seconds))
    offs = F.array(F.lit(0), F.lit(1)) if forward_only else F.array(F.lit(-1), F.lit(0), F.lit(1))
    rb = right.withColumn("_ij_b", F.explode(F.transform(offs, lambda o: time_bucket(right_ts, max_gap_seconds) - o)))
    key = [*on, "_ij_b"]
    n_left = lb.groupBy(*key).agg(F.count(F.lit(1)).alias("_nl"))
    n_right = rb.groupBy(*key).agg(F.count(F.lit(1)).alias("_nr"))
    # Only keys of more than a block are listed; the others are block 0.
    large = n_left.join(n_right, key).where((F.col("_nl") > block) | (F.col("_nr") > block)).select(
        *key, F.ceil(F.col("_nl") / block).cast("int").alias("_bl"), F.ceil(F.col("_nr") / block).cast("int").alias("_br"),
        "_nl", "_nr")
    large = staged(large, "large-keys")
    none = large.isEmpty()

    def dealt(df: DataFrame, count: str, mine: str, own: str, others: str, other: str) -> DataFrame:
        if none:
            return df.withColumns({own: F.lit(0), other: F.lit(0)})
        x = at_values(df, large.withColumnRenamed(count, "_cnt").select(*key, "_cnt", "_bl", "_br"), key)
        one = F.lit(1)
        return x.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.coalesce(mine, one)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.coalesce(others, one) - 1))).drop("_bl", "_br")

    joined = dealt(lb, "_nl", "_bl", "_i", "_br", "_j").join(dealt(rb, "_nr", "_br", "_j", "_bl", "_i"), [*key, "_i", "_j"])
    gap = F.unix_seconds(F.col(right_ts)) - F.unix_seconds(F.col(left_ts))
    cond = (gap >= 0) & (gap <= max_gap_seconds) if forward_only else F.abs(gap) <= max_gap_seconds
    return joined.where(cond).drop("_ij_b", "_i", "_j")


def range_sums(events: DataFrame, on: Sequence[str], seconds: str, width: int,
               before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """Every event with sums over the other events of its key that lie at most
    ``width`` seconds before (or after) it, strictly: ``before`` and ``after``
    map names to the column summed.

    Events are sent to their time bucket and its neighbours, so that a busy key is
    split by time. Within (key, bucket) a sum over a window of time is the
    difference of two frames that only grow: each event is added once to each, where a
    sliding frame would be added up anew for every row. Work is linear."""
    b = F.floor(F.col(seconds) / width).cast("long")
    x = events.withColumn("_own", b).withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)))
    w = Window.partitionBy(*on, "_bucket").orderBy(seconds)

    def upto(c: str, end: int) -> Column:
        return F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))

    x = x.withColumns({n: upto(c, -1) - upto(c, -width - 1) for n, c in before.items()}
                      | {n: upto(c, width) - upto(c, 0) for n, c in after.items()})
    return x.where(F.col("_own") == F.col("_bucket")).drop("_own", "_bucket")


def window_join(facts: DataFrame, fact_ts: str, windows: DataFrame, lo: str, hi: str,
                how: str = "inner", bucket_seconds: int = 86_400, on: Sequence[str] = ()) -> DataFrame:
    """Facts with ``lo < fact_ts <= hi`` and equal ``on`` keys (kept once) for each
    window (``lo`` NULL = no lower bound). ``how`` is ``inner`` or ``left`` (windows
    kept).

    Windows are exploded over the time buckets they cover and facts carry
    their bucket, so the range join becomes an equi-join on the bucket with a
    residual range test; release windows are disjoint, so the exploded side
    has at most (#windows + #buckets) rows. Column names of the two sides must
    not clash apart from being disambiguated by the caller."""
    earliest = facts.select(F.min(fact_ts)).scalar()
    lo_b = time_bucket(F.coalesce(F.col(lo), earliest), bucket_seconds)
    hi_b = time_bucket(F.col(hi), bucket_seconds)
    buckets = F.when(lo_b <= hi_b, F.sequence(lo_b, hi_b)).otherwise(F.array().cast("array<bigint>"))
    w = windows.withColumn("_wj_b", F.explode_outer(buckets))
    f = facts.withColumn("_wj_fb", time_bucket(fact_ts, bucket_seconds)).withColumnsRenamed(
        {c: f"_wj_{c}" for c in on})
    cond = ((w["_wj_b"] == f["_wj_fb"]) & (w[lo].isNull() | (f[fact_ts] > w[lo]))
            & (f[fact_ts] <= w[hi]))
    for c in on:
        cond = cond & (w[c] == f[f"_wj_{c}"])
    return w.join(f, cond, how).drop("_wj_b", "_wj_fb", *[f"_wj_{c}" for c in on])
