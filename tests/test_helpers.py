"""Join and sequence helpers against brute force on small random inputs,
including a hot key holding a large share of the rows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vcscope.operators.joins import interval_pairs, range_sums, substring_join, window_join
from vcscope.operators.sequence import segmented_lag
from vcscope.operators.stats import percent_rank, quantiles, histogram, rank_desc

BASE = dt.datetime(2024, 1, 1)


def _events(n, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 30)}"
        rows.append((key, i, BASE + dt.timedelta(seconds=rnd.randint(0, 40 * 86400)), rnd.randint(0, 9)))
    return rows


def test_segmented_lag_matches_window(spark):
    df = spark.createDataFrame(_events(3000), "k string, id long, ts timestamp, v int")
    got = segmented_lag(df, ["k"], ["ts", "id"], "v", (1, 2), prefix="p", num_segments=13)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.withColumn("p1", F.lag("v", 1).over(w)).withColumn("p2", F.lag("v", 2).over(w))
    cols = ["k", "id", "p1", "p2"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_segmented_lag_global(spark):
    df = spark.createDataFrame(_events(500, 3), "k string, id long, ts timestamp, v int")
    got = segmented_lag(df, [], ["ts", "id"], "id", (1,), prefix="p", num_segments=7)
    want = df.withColumn("p1", F.lag("id", 1).over(Window.orderBy("ts", "id")))
    assert sorted(got.select("id", "p1").collect()) == sorted(want.select("id", "p1").collect())


def test_interval_pairs_brute_force(spark):
    ev = _events(400, 11)
    df = spark.createDataFrame(ev, "k string, id long, ts timestamp, v int")
    left = df.select("k", F.col("id").alias("a"), F.col("ts").alias("t1"))
    right = df.select("k", F.col("id").alias("b"), F.col("ts").alias("t2"))
    gap = 86400
    got = {(r.a, r.b) for r in interval_pairs(left, right, ["k"], "t1", "t2", gap).collect()}
    want = {(x[1], y[1]) for x in ev for y in ev
            if x[0] == y[0] and abs((y[2] - x[2]).total_seconds()) <= gap}
    assert got == want
    fwd = {(r.a, r.b) for r in interval_pairs(left, right, ["k"], "t1", "t2", gap, forward_only=True).collect()}
    assert fwd == {(a, b) for a, b in want
                   if 0 <= (ev[b][2] - ev[a][2]).total_seconds() <= gap}


def test_window_join_brute_force(spark):
    ev = _events(300, 5)
    facts = spark.createDataFrame([(i, ts) for _, i, ts, _ in ev], "id long, ts timestamp")
    cuts = sorted(BASE + dt.timedelta(days=d, hours=h) for d, h in [(3, 1), (9, 5), (9, 5), (20, 0), (35, 2)])
    wins = [(f"w{i}", cuts[i - 1] if i else None, c) for i, c in enumerate(cuts)]
    w = spark.createDataFrame(wins, "name string, lo timestamp, hi timestamp")
    got = sorted((r.name, r.id) for r in window_join(facts, "ts", w, "lo", "hi").collect())
    want = sorted((n, i) for n, lo, hi in wins for _, i, ts, _ in ev if (lo is None or ts > lo) and ts <= hi)
    assert got == want
    left = window_join(facts, "ts", w, "lo", "hi", how="left").groupBy("name").agg(F.count("id").alias("n"))
    counts = {r.name: r.n for r in left.collect()}
    assert counts["w2"] == 0 and sum(counts.values()) == len(want)


def test_substring_join_brute_force(spark):
    texts = [(1, "merge feature/12 and feature/1"), (2, "nothing here"), (3, "feature/1feature/1"),
             (4, "fix wip-branch"), (5, "")]
    names = ["feature/1", "feature/12", "wip", "wip-branch", "zzz"]
    left = spark.createDataFrame([("r", i, t) for i, t in texts], "repo string, id long, text string")
    right = spark.createDataFrame([("r", n) for n in names], "repo string, name string")
    got = sorted((r.id, r.name) for r in
                 substring_join(left, "text", right, "name", on=["repo"], left_key=["id"]).collect())
    want = sorted((i, n) for i, t in texts for n in names if n in t)
    assert got == want


def test_stats_match_pandas(spark):
    import pandas as pd
    rnd = random.Random(1)
    vals = [rnd.randint(0, 50) for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    h = histogram(df, "x")
    q = h.agg(*quantiles(h, "x", [0.25, 0.5, 0.95], ["a", "b", "c"])).first()
    s = pd.Series(vals)
    assert [q.a, q.b, q.c] == [round(s.quantile(p), 6) for p in (0.25, 0.5, 0.95)]
    pr = {r.x: r.pr for r in percent_rank(df.distinct(), "x", "pr").collect()}
    d = sorted(set(vals))
    assert all(abs(pr[v] - i / (len(d) - 1)) < 1e-12 for i, v in enumerate(d))
    rk = {r.x: r.rk for r in rank_desc(df.distinct(), "x", "rk").collect()}
    assert rk[max(d)] == 1 and rk[min(d)] == len(d)


def test_substring_join_many_lengths(spark):
    names = ["n" * k + "x" for k in range(1, 2001)]
    left = spark.createDataFrame([("r", 1, "n" * 1500 + "x"), ("r", 2, "nnx"), ("r", 3, "abc")],
                                 "repo string, id long, text string")
    right = spark.createDataFrame([("r", n) for n in names], "repo string, name string")
    got = substring_join(left, "text", right, "name", on=["repo"], left_key=["id"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 1500, 2: 2}


def test_components_of_a_long_chain(spark):
    from vcscope.operators.graph import connected_components
    rnd = random.Random(4)
    names = rnd.sample(range(10**6), 1000)
    edges = list(zip(names, names[1:])) + [(2 * 10**6, 2 * 10**6 + 1), (3 * 10**6, 3 * 10**6), (None, 5)]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in connected_components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {n: min(names) for n in names} | {2 * 10**6: 2 * 10**6, 2 * 10**6 + 1: 2 * 10**6, 3 * 10**6: 3 * 10**6}
    assert got == want


def test_pairs_of_a_hot_group_are_spread(spark):
    from vcscope.operators.collab import pairs_within
    n = 1200
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("x")).unionByName(
        spark.createDataFrame([("h", 1), ("h", 2), ("h", 2), ("i", 5)], "g string, x long"))
    p = pairs_within(df, ["g"], "x", block=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["count"] for r in p.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == n * (n - 1) // 2 + 1 and max(per_task) < 0.5 * sum(per_task)
    assert p.where("item_a >= item_b").isEmpty() and p.distinct().count() == sum(per_task)


def test_range_sums_brute_force(spark):
    rnd = random.Random(9)
    ev = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}", i, rnd.randint(0, 900), rnd.randint(0, 5)) for i in range(900)]
    df = spark.createDataFrame(ev, "k string, id long, at long, v long")
    got = {r.id: (r.b, r.a) for r in range_sums(df, ["k"], "at", 60, {"b": "v"}, {"a": "v"}).collect()}
    assert got == {i: (sum(w for q, _, s, w in ev if q == k and 0 < at - s <= 60),
                       sum(w for q, _, s, w in ev if q == k and 0 < s - at <= 60)) for k, i, at, _ in ev}


def test_range_sums_of_a_busy_key_are_linear(spark):
    """80,000 events of one file in 30 days; a sliding frame took minutes for them."""
    import bisect
    import time
    rnd = random.Random(2)
    at = sorted(rnd.randint(0, 30 * 86400) for _ in range(80_000))
    df = spark.createDataFrame([("f", s, 1) for s in at], "k string, at long, v long").cache()
    df.count()
    t0 = time.time()
    got = range_sums(df, ["k"], "at", 30 * 86400, {"b": "v"}, {"a": "v"}).agg(F.sum("b"), F.sum("a")).first()
    assert time.time() - t0 < 20
    assert got[0] == got[1] == sum(bisect.bisect_left(at, s) for s in at)


def _authors_of_modules(n=4000):
    rnd = random.Random(6)
    return [("hot" if rnd.random() < 0.9 else f"m{rnd.randint(0, 5)}", f"a{i}", rnd.randint(0, 30)) for i in range(n)]


def test_running_sums_of_a_hot_key(spark):
    """One module holds 90 % of the authors; ranks equal a window's, no task holds it."""
    from vcscope.operators.stats import running
    df = spark.createDataFrame(_authors_of_modules(), "module string, author string, lines long").withColumn("one", F.lit(1))
    order = [F.desc("lines"), F.asc("author")]
    got = running(df, ["module"], order, {"rk": "one", "cum": "lines"})
    w = Window.partitionBy("module").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"rk": F.sum("one").over(w), "cum": F.sum("lines").over(w),
                           "all": F.sum("lines").over(Window.partitionBy("module"))})
    cols = ["module", "author", "rk", "cum"]
    assert sorted(got.select(*cols, "cum_all").collect()) == sorted(want.select(*cols, "all").collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window " in line or "+- Window" in line]
    assert windows and all("_part" in line for line in windows)
    sizes = got.select("module", "author").join(df, ["module", "author"]).count()
    assert sizes == df.count()


def test_ranks_of_a_hot_value(spark):
    """90 % of the rows share a value, and nothing is broadcast for its size."""
    from vcscope.operators.stats import at_values, mean_percent_rank
    rnd = random.Random(8)
    rows = [(i, 1 if rnd.random() < 0.9 else rnd.randint(2, 50), rnd.choice(["x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long, g string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for by in ([], ["g"]):
            w = Window.partitionBy(*by)
            want = {r.id: (round(r.p, 12), r.r) for r in df.withColumns(
                {"p": F.percent_rank().over(w.orderBy("v")), "r": F.rank().over(w.orderBy(F.desc("v")))}).collect()}
            pr = {r.id: round(r.p, 12) for r in percent_rank(df, "v", "p", by).collect()}
            rk = {r.id: r.r for r in rank_desc(df, "v", "r", by).collect()}
            mean = {r.id: round(r.m, 12) for r in mean_percent_rank(df, "id", ["v", "v"], "m", by).collect()}
            assert pr == mean == {i: x[0] for i, x in want.items()} and rk == {i: x[1] for i, x in want.items()}
        h = df.groupBy("v").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("of", F.col("v") * 2)
        at = at_values(df, h, ["v"]).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in at.groupBy("task").count().collect()]
        assert max(per_task) < 0.5 * len(rows) and at.where("of = v * 2").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_interval_pairs_of_a_busy_author(spark):
    """A bot changes 5,000 files in a day; its pairs are spread over all tasks."""
    rnd = random.Random(12)
    ev = [("bot", i, BASE + dt.timedelta(seconds=rnd.randint(0, 86399))) for i in range(600)]
    ev += [(f"a{i % 20}", 1000 + i, BASE + dt.timedelta(seconds=rnd.randint(0, 9 * 86400))) for i in range(200)]
    df = spark.createDataFrame(ev, "k string, id long, ts timestamp")
    left, right = df.select("k", F.col("id").alias("a"), F.col("ts").alias("t1")), df.select(
        "k", F.col("id").alias("b"), F.col("ts").alias("t2"))
    want = {(x[1], y[1]) for x in ev for y in ev if x[0] == y[0] and abs((y[2] - x[2]).total_seconds()) <= 86400}
    rows = [(r.a, r.b) for r in interval_pairs(left, right, ["k"], "t1", "t2", 86400, block=64).collect()]
    assert len(rows) == len(want) and set(rows) == want
    bot = spark.range(5000).select(F.lit("bot").alias("k"), "id", (F.lit(BASE) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("id") * 17)).alias("ts"))
    left, right = (bot.select("k", F.col("id").alias(n), F.col("ts").alias(f"t{n}")) for n in ("a", "b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = interval_pairs(left, right, ["k"], "ta", "tb", 86400, block=256).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in p.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reach = 86400 // 17
    assert sum(per_task) == sum(min(i + reach, 4999) - max(i - reach, 0) + 1 for i in range(5000))
    assert len(per_task) == 8 and max(per_task) < 0.4 * sum(per_task)


def test_few_grams_pass_that_no_name_has(spark):
    """Before, a gram's hash was one of 2^20, of which the names of a large history take a third: a
    third of all grams of all texts was shuffled. 30,000 names let 2.9 in 100 pass."""
    from vcscope.operators.joins import _possible
    gram = lambda k: F.substring(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256), 1, 8).alias("_gram")
    names = spark.range(30000).select(F.lit("r").alias("repo"), gram("name"))
    texts = spark.range(50000).select(F.lit("r").alias("repo"), gram("text"))
    kept = _possible(texts.unionByName(names.limit(100)), names, ["repo"])
    assert kept.join(names, ["repo", "_gram"], "left_semi").count() >= 100
    assert kept.count() < 100 + 0.005 * 50000
