"""Order-dependent operators that stay balanced when a partition key is hot.

A plain ``lag().over(Window.partitionBy(key).orderBy(t))`` sends every row of
one key to one task. History keys are very skewed (five repositories; one
author or one file can own a third of all rows; a global order has a single
key), so the lag here is computed in *segments*:

1. range-partition by (key, order) into N segments — the range partitioner
   samples the data, so a hot key is split over many segments;
2. lag inside each (key, segment) with an ordinary window (balanced);
3. the first ``k`` rows of each segment take their predecessors from the last
   ``k`` rows of the preceding segments of the same key, found through a tiny
   per-segment summary (at most ``k`` values per (key, segment)).

The result is exact and equals the plain window result. The segmented rows
are checkpointed (eagerly), so the operator runs one job when it is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _n_segments(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def segmented_lag(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str],
                  value: str, offsets: Sequence[int] = (1,), prefix: str | None = None,
                  num_segments: int | None = None) -> DataFrame:
    """Add ``{prefix}{k}`` = ``value`` ``k`` rows earlier within ``partition_by``
    in ``order_by`` order (NULL when there is none), for every ``k`` in
    ``offsets``. ``order_by`` must be a total order inside each key (add a
    unique tie-breaker); ascending only."""
    prefix = prefix if prefix is not None else f"prev_{value}_"
    keys = list(partition_by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    kmax = max(offsets)
    n = _n_segments(df, num_segments)

    seg = "_vc_seg"
    ranged = (df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                .withColumn(seg, F.spark_partition_id()))

    w = Window.partitionBy(*keys, seg).orderBy(*order)
    w_all = Window.partitionBy(*keys, seg)
    x = ranged.withColumn("_vc_rn", F.row_number().over(w)).withColumn(
        "_vc_cnt", F.count(F.lit(1)).over(w_all))
    for k in offsets:
        x = x.withColumn(f"{prefix}{k}", F.lag(value, k).over(w))
    # Segment ids come from a sampled range partitioner; the three branches
    # below must see the same ids, so the segmented rows are materialised once
    # (a reliable checkpoint in the shared folder, which also cuts lineage).
    checkpoint_dir(df.sparkSession)
    x = x.checkpoint(eager=True)

    # per (key, segment): its last kmax values, in order
    tails = (x.filter(F.col("_vc_rn") > F.col("_vc_cnt") - kmax)
              .groupBy(*keys, seg)
              .agg(F.sort_array(F.collect_list(F.struct("_vc_rn", F.col(value).alias("v"))))
                   .alias("_vc_tail")))
    tails = tails.select(*keys, seg, F.transform("_vc_tail", lambda s: s["v"]).alias("_vc_tail"))
    # context of a segment: the tails of up to kmax preceding segments of the key
    # (every segment holds at least one row, so kmax segments always suffice)
    wt = Window.partitionBy(*keys).orderBy(seg).rowsBetween(-kmax, -1)
    ctx = tails.select(*keys, seg, F.flatten(F.collect_list("_vc_tail").over(wt)).alias("_vc_ctx"))
    ctx = ctx.select(*keys, seg, F.slice("_vc_ctx", F.greatest(F.size("_vc_ctx") - kmax + 1, F.lit(1)),
                                          F.lit(kmax)).alias("_vc_ctx"))

    heads = x.filter(F.col("_vc_rn") <= kmax).join(ctx, on=[*keys, seg], how="left")
    fills = {}
    for k in offsets:
        idx = F.size("_vc_ctx") - F.lit(k) + F.col("_vc_rn")
        fills[f"{prefix}{k}"] = F.when(
            F.col("_vc_rn") <= k,
            F.when(F.col("_vc_ctx").isNotNull() & (idx >= 1), F.try_element_at("_vc_ctx", idx)),
        ).otherwise(F.col(f"{prefix}{k}"))
    heads = heads.withColumns(fills).drop("_vc_ctx")
    rest = x.filter(F.col("_vc_rn") > kmax)
    out = heads.unionByName(rest)
    return out.drop(seg, "_vc_rn", "_vc_cnt")
