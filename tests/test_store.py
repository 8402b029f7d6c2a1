"""The versioned store, open SQL of several handles, and the dialect's functions."""

import datetime as dt
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vcscope.tables import Store, Tables, data_folder


@pytest.fixture(scope="module")
def tables(spark):
    from vcscope.plans import catalog
    return catalog.index_tables(spark, SF_SMALL)


def test_a_failed_rebuild_leaves_the_store_whole(spark, tables, tmp_path):
    store = str(tmp_path / "store")
    tables.write(store)
    n = tables.commits.count()
    fails = tables.tags.withColumn("tag_message", F.raise_error(F.lit("stopped between tables")).cast("string"))
    less = Tables(tables.commits.limit(5), tables.file_changes.limit(5), tables.commit_parents, tables.branches, fails)
    with pytest.raises(Exception, match="stopped between tables"):
        less.write(store)
    back = Tables.read(spark, store)
    assert back.commits.count() == n and back.file_changes.count() == tables.file_changes.count()
    assert back.tags.count() == tables.tags.count() and len(Store(spark, store).versions()) == 1


def test_versions_follow_each_other(spark, tables, tmp_path):
    store = str(tmp_path / "store")
    first = tables.write(store)
    reader = Tables.read(spark, store)
    one = tables.of_repos("BUILDING")
    second = one.write(store, also={"rejects": one.tags})
    # A job that reads the version before goes on with it.
    assert reader.commits.count() == tables.commits.count()
    assert Tables.read(spark, store).commits.count() == one.commits.count()
    assert Tables.read(spark, store, first).commits.count() == tables.commits.count()
    assert spark.read.parquet(f"{data_folder(spark, store)}/rejects").count() == one.tags.count()
    third = one.write(store)
    assert Store(spark, store).versions() == [second, third] and first < second < third
    assert sorted(os.listdir(store)) == sorted(["_versions", second.split("-")[1], third.split("-")[1]])
    with pytest.raises(FileNotFoundError):
        Tables.read(spark, store, first)
    with pytest.raises(FileNotFoundError):
        Tables.read(spark, str(tmp_path / "nothing"))


def test_handles_side_by_side_answer_from_their_own_data(tables):
    a, b = tables.of_repos("BUILDING"), tables.of_repos("MACHINERY")
    q = "SELECT repo_name, COUNT(*) AS n FROM commits GROUP BY repo_name"
    first = a.sql(q)
    second = b.sql(f"-- with a comment\nWITH c AS ({q}) SELECT * FROM c")
    assert [r.repo_name for r in first.collect()] == ["BUILDING"]
    assert [r.repo_name for r in second.collect()] == ["MACHINERY"]
    assert [r.repo_name for r in first.collect()] == ["BUILDING"]
    assert not a.spark.catalog.tableExists("commits")


TIMES = ["2024-01-01T00:00:00Z", "2023-12-31T23:59:59Z", "2024-02-29T12:30:05Z", "1999-07-04T06:07:08Z", "2021-01-04T00:00:00Z"]
FORMATS = ["%Y-%m-%d", "%H:%M:%S", "%s", "%j", "%w", "%W", "100%% %Y%m", "week %W of %Y", "plain"]
PATTERNS = ["*.py", "src/*", "?.py", "[a-c]*", "[^a-c]*", "*.[ch]", "a+b.(c)", "*", "", "x^y", "A*"]
PATHS = ["a.py", "src/a.py", "d.py", "b.c", "a+b.(c)", "aab.c", "", "x^y", "Ab", "line\nfeed.py", "src/"]


def test_dialect_functions_match_sqlite(spark, tables):
    con = sqlite3.connect(":memory:")
    got = tables.sql("SELECT t, julianday(t) AS j, " + ", ".join(
        f"strftime('{f}', t) AS f{i}" for i, f in enumerate(FORMATS)) + " FROM VALUES " + ", ".join(f"('{t}')" for t in TIMES) + " AS v(t)")
    for r in got.collect():
        want = con.execute("SELECT julianday(?1), " + ", ".join(f"strftime('{f}', ?1)" for f in FORMATS), (r.t,)).fetchone()
        assert abs(r.j - want[0]) < 1e-6 and list(r)[2:] == list(want[1:])
    rows = spark.createDataFrame([(p, x) for p in PATTERNS for x in PATHS], "p string, x string")
    rows.createOrReplaceTempView("dialect_glob_rows")
    for r in tables.sql("SELECT p, x, glob(p, x) AS hit FROM dialect_glob_rows").collect():
        assert r.hit == bool(con.execute("SELECT ? GLOB ?", (r.x, r.p)).fetchone()[0]), (r.p, r.x)


def test_dialect_of_timestamps(tables):
    r = tables.sql("SELECT julianday(max(date)) - julianday(min(date)) AS days, max(date) AS hi, min(date) AS lo, "
                   "strftime('%Y', 'no time') AS none, julianday(NULL) AS nothing FROM commits").first()
    assert abs(r.days - (r.hi - r.lo) / dt.timedelta(days=1)) < 1e-6 and r.none is None and r.nothing is None


def test_only_grams_that_can_match_are_joined(spark):
    from vcscope.operators.joins import substring_join
    left = spark.range(2000).select(F.lit("r").alias("repo"), "id", F.concat(
        F.lit("some long message about nothing in particular, number "), F.col("id").cast("string"),
        F.when(F.col("id") % 100 == 0, F.lit(" merges feature/the-name")).otherwise(F.lit(""))).alias("text"))
    right = spark.createDataFrame([("r", "feature/the-name"), ("r", "feature/other")], "repo string, name string")
    got = substring_join(left, "text", right, "name", on=["repo"], left_key=["id"])
    assert sorted(r.id for r in got.collect()) == list(range(0, 2000, 100))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_a_query_makes_only_the_tables_it_reads(spark):
    from vcscope.sources import fixtures
    from vcscope.tables import NAMES
    asked = []
    whole = fixtures.load(spark, SF_SMALL)
    t = Tables(**{n: lambda n=n: asked.append(n) or getattr(whole, n) for n in NAMES})
    assert t.by_repo().of_repos("BUILDING").commits.count() == whole.commits.where("repo_name = 'BUILDING'").count()
    assert asked == ["commits"]
    assert t.between("1996-01-01", None).tags.count() > 0 and asked == ["commits", "tags"]
    assert t.sql("SELECT COUNT(*) AS n FROM branches").first().n == whole.branches.count()
    assert asked == ["commits", "tags", "branches"]


def test_totals_of_orders_and_parts_given_twice(spark, tmp_path):
    from vcscope.sources import fixtures
    from vcscope.sources.rollup import ROLLUPS, rollup_exprs
    for name in ("customer", "orders", "lineitem", "part"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        key = df.columns[0]
        if name == "lineitem":
            odd = df.limit(20).withColumn(key, F.lit(None).cast("long"))
        else:
            odd = df.where(F.col(key) % 3 == 0)
        df.unionByName(odd).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = fixtures.load(spark, str(tmp_path))
    own = ["repo_name", "commit_hash"]
    sums = {r[:2]: r[2:] for r in t.file_changes.groupBy(*own).agg(*rollup_exprs()).collect()}
    got = t.commits.select(*own, *ROLLUPS).collect()
    assert len(got) > 1500 and len({r[:2] for r in got}) < len(got)
    for r in got:
        assert r[2:] == sums.get(r[:2], (0,) * len(ROLLUPS))


def test_releases_meet_commits_by_the_hour(tables):
    from vcscope.operators.ingestion import adhoc_sql_releases
    plan = adhoc_sql_releases(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "hour" in plan.split("LeftOuter")[1].split("\n")[0]


def test_dumps_are_compressed_and_in_log_order(spark, tables, tmp_path):
    """Before, dumps were plain text, most of an ingestion's disk, and their texts were moved."""
    import glob
    import gzip
    from vcscope.sources import render
    render.write_dumps(tables, str(tmp_path / "d"))
    files = sorted(glob.glob(str(tmp_path / "d" / "*.log" / "part-*")))
    assert files and all(f.endswith(".gz") for f in files)
    dates = {r.commit_hash: r.date for r in tables.commits.withColumn(
        "commit_hash", render.padded(F.col("commit_hash"))).collect()}
    seen = 0
    for repo in glob.glob(str(tmp_path / "d" / "*.log")):
        text = "".join(gzip.open(f, "rt").read() for f in sorted(glob.glob(f"{repo}/part-*")))
        hashes = [x.split("\n")[0] for x in ("\n" + text).split("\ncommit:")[1:] if x[0] == "c"]
        assert [dates[h] for h in hashes] == sorted((dates[h] for h in hashes), reverse=True)
        seen += len(hashes)
    assert seen == tables.commits.count()


def test_staged_writes_leave_no_shuffle_files(spark):
    import time
    from vcscope.session import staged
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffles()
    out = staged(spark.range(20000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_partitions_follow_the_input(spark):
    from vcscope import session
    key, before = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", session.partitions(spark)
    assert before == 8
    try:
        session.fit_partitions(spark, 3 * session.PARTITION_BYTES)
        assert session.partitions(spark) == 8
        session.fit_partitions(spark, 40 * session.PARTITION_BYTES)
        assert session.partitions(spark) == 40 and spark.conf.get(key) == "40"
    finally:
        spark.conf.unset(key)
    assert session.partitions(spark) == 8


def test_file_changes_move_as_keys(spark):
    """Before, hashes, authors and empty columns were moved with every change."""
    from vcscope.sources import fixtures
    rows = fixtures.change_rows(spark, SF_SMALL, fixtures.commits_base(spark, SF_SMALL))
    assert not {"commit_hash", "author", "similarity", "new_path"} & set(rows.columns)
