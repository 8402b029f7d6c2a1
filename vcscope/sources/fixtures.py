"""Adapter from the driver's star-schema tables to the five history tables.

Orders are commits, line items are file changes, market segments are
repositories, parts name the changed files. Everything is derived by Spark from
the given parquet tables, so the work grows with them.

``DUCKDB_VIEWS`` is the same derivation as SQL text, used by the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import classify
from ..operators.joins import substring_join
from ..operators.sequence import segmented_lag
from ..tables import NAMES, Tables, clustered, read_table, write_table
from .rollup import ROLLUPS, rollup_exprs


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def _hash(okey: str) -> F.Column:
    return F.concat(F.lit("c"), _s(okey))


def _author(custkey: str) -> F.Column:
    ck = F.col(custkey)
    return F.when(ck % 7 == 0, F.concat(F.lit("guest"), _s(custkey))).otherwise(
        F.concat(F.lit("dev"), (ck % 200).cast("string")))


def commits_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order; keeps ``_okey`` for the line-item join."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    merge = F.col("o_orderpriority").startswith("1-")
    message = F.concat(
        F.when(merge, F.concat(F.lit("Merge pull request #"), _s("o_orderkey"),
                               F.lit(" from feature/"), _s("o_custkey")))
         .when(F.col("o_orderstatus") == "F", F.concat(F.lit("Fix bug #"), _s("o_orderkey")))
         .when(F.col("o_orderstatus") == "P", F.concat(F.lit("Refactor pricing #"), _s("o_orderkey")))
         .otherwise(F.concat(F.lit("Add feature #"), _s("o_orderkey"))),
        F.when(ck % 5 == 0, F.concat(F.lit(" Co-authored-by: dev"), (ck % 199).cast("string"))).otherwise(F.lit("")),
        F.when(ok % 97 == 0, F.lit(" resolve conflict")).otherwise(F.lit("")),
    )
    return j.select(
        ok.alias("_okey"),
        _hash("o_orderkey").alias("commit_hash"),
        F.col("c_mktsegment").alias("repo_name"),
        _author("o_custkey").alias("author"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (ok * 7919) % 86400).alias("date"),
        F.when(ck % 4 == 0, "Z").when(ck % 4 == 1, "+02:00").when(ck % 4 == 2, "-05:00")
         .otherwise("+05:30").alias("timezone"),
        F.when(merge, 1).otherwise(0).alias("is_merge"),
        message.alias("message"),
        F.col("o_custkey").alias("_custkey"),
        F.col("o_orderdate").cast("timestamp").alias("_odate"),
    )


def parts_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, file_path and its classes: the path depends on the part only, so it is
    built and classified once per part, before the join with the (much larger) line items."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    n = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), _s("p_partkey"))
    t = F.lower("p_type")
    k = F.col("p_partkey") % 10
    path = (F.when(k == 0, F.concat(F.lit("src/main/"), t, F.lit("/"), n, F.lit(".java")))
             .when(k == 1, F.concat(t, F.lit("/src/test/java/"), n, F.lit("Test.java")))
             .when(k == 2, F.concat(F.lit("web/"), t, F.lit("/"), n, F.lit(".ts")))
             .when(k == 3, F.concat(F.lit("web/"), t, F.lit("/"), n, F.lit(".spec.ts")))
             .when(k == 4, F.concat(t, F.lit("/pom.xml")))
             .when(k == 5, F.concat(F.lit(".github/workflows/"), n, F.lit(".yml")))
             .when(k == 6, F.concat(F.lit("docs/"), t, F.lit("/"), n, F.lit(".md")))
             .when(k == 7, F.concat(F.lit("db/"), t, F.lit("/"), n, F.lit(".sql")))
             .when(k == 8, F.concat(F.lit("lib/"), t, F.lit("/"), n, F.lit(".py")))
             .otherwise(F.concat(t, F.lit("/README.md"))))
    return classify.with_flags(p.select("p_partkey", path.alias("file_path")), "file_path")


def _change_type() -> F.Column:
    ln = F.col("l_linenumber") % 7
    return F.when(ln == 1, "A").when(ln == 6, "D").when(ln == 0, "R").otherwise("M")


def _lines() -> dict[str, F.Column]:
    return {"additions": F.round("l_quantity").cast("long"), "deletions": F.round(F.col("l_discount") * 100).cast("long")}


def change_rows(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    """What ``file_changes_of`` makes the table of: keys and numbers instead of the texts
    made of them, so that less is moved."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity", "l_discount")
    parts = parts_from(spark, sf_dir)
    cm = commits.select("_okey", "_custkey", "repo_name")
    j = li.join(cm, li.l_orderkey == cm._okey, "inner").join(parts, li.l_partkey == parts.p_partkey, "inner")
    return j.select(
        F.xxhash64("repo_name", _hash("_okey"), "file_path", "l_linenumber", "l_partkey", "l_suppkey",
                   *_lines().values()).alias("id"),
        "_okey", "_custkey", "repo_name", "l_linenumber", "file_path", "l_quantity", "l_discount", *classify.CLASSES)


def file_changes_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", _hash("_okey").alias("commit_hash"), "repo_name", _author("_custkey").alias("author"),
        _change_type().alias("change_type"), "file_path", *[c.alias(n) for n, c in _lines().items()],
        "is_test_file", "is_build_file", "is_dot_file", "is_documentation_file",
        F.lit(None).cast("int").alias("similarity"), F.lit(None).cast("string").alias("new_path"),
    )


def tags_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where(F.col("o_orderkey") % 300 == 0)
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("v"), _s("o_orderkey")).alias("tag_name"),
        F.col("c_mktsegment").alias("repo_name"),
        F.concat(F.lit("c"), _s("o_orderkey")).alias("tag_commit"),
        F.lit("Release").alias("tag_message"),
    )


def branches_from(commits: DataFrame) -> DataFrame:
    """A branch ``feature/<customer>`` per customer key divisible by 10, created
    at its first order; merged by the newest merge commit naming it."""
    base = (commits.where(F.col("_custkey") % 10 == 0)
            .groupBy("_custkey", "repo_name")
            .agg(F.min("_odate").alias("creation_date"))
            .select(F.concat(F.lit("feature/"), _s("_custkey")).alias("branch_name"),
                    "repo_name", "creation_date"))
    merges = commits.where(F.col("is_merge") == 1).select("repo_name", "commit_hash", "message", "date")
    hits = (substring_join(merges, "message", base.select("repo_name", "branch_name"), "branch_name",
                           on=["repo_name"], left_key=["commit_hash"])
            .groupBy("repo_name", "branch_name").agg(F.max("date").alias("merge_date")))
    return (base.join(hits, ["repo_name", "branch_name"], "left")
            .select("branch_name", "repo_name",
                    F.when(F.col("merge_date").isNull(), 1).otherwise(0).alias("is_active"),
                    "creation_date", "merge_date"))


def parents_from(commits: DataFrame) -> DataFrame:
    """Linear history per repository; merges also get the commit before."""
    lagged = segmented_lag(commits.select("repo_name", "commit_hash", "date", "is_merge"),
                           ["repo_name"], ["date", "commit_hash"], "commit_hash", offsets=(1, 2), prefix="p")
    first = lagged.where(F.col("p1").isNotNull()).select("commit_hash", "repo_name", F.col("p1").alias("parent_hash"))
    second = (lagged.where((F.col("is_merge") == 1) & F.col("p2").isNotNull())
              .select("commit_hash", "repo_name", F.col("p2").alias("parent_hash")))
    return first.unionByName(second)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy history tables derived from the driver tables in ``sf_dir``."""
    cb = commits_base(spark, sf_dir)
    return Tables(
        commits=commits_from(spark, sf_dir, cb),
        file_changes=file_changes_of(change_rows(spark, sf_dir, cb)),
        commit_parents=parents_from(cb),
        branches=branches_from(cb),
        tags=tags_from(spark, sf_dir),
    )


# ---------------------------------------------------------------------------
# The same derivation as DuckDB SQL (oracle side). Views: orders, customer,
# lineitem, part are registered by the driver.

def _flags_sql() -> str:
    return ",\n  ".join(f"{classify.duckdb_flag_sql('file_path', n)} AS {n}" for n in classify.CLASSES)


def duckdb_views() -> str:
    """``WITH`` clause defining commits, file_changes, commit_parents, branches
    and tags over the driver tables (no trailing select)."""
    return f"""WITH commits_base AS (
SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS commit_hash, c_mktsegment AS repo_name,
  CASE WHEN o_custkey % 7 = 0 THEN 'guest' || CAST(o_custkey AS VARCHAR) ELSE 'dev' || CAST(o_custkey % 200 AS VARCHAR) END AS author,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * CAST((o_orderkey * 7919) % 86400 AS INTEGER) AS date,
  CASE o_custkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-05:00' ELSE '+05:30' END AS timezone,
  CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END AS is_merge,
  CASE WHEN o_orderpriority LIKE '1-%' THEN 'Merge pull request #' || CAST(o_orderkey AS VARCHAR) || ' from feature/' || CAST(o_custkey AS VARCHAR)
       WHEN o_orderstatus = 'F' THEN 'Fix bug #' || CAST(o_orderkey AS VARCHAR)
       WHEN o_orderstatus = 'P' THEN 'Refactor pricing #' || CAST(o_orderkey AS VARCHAR)
       ELSE 'Add feature #' || CAST(o_orderkey AS VARCHAR) END
  || CASE WHEN o_custkey % 5 = 0 THEN ' Co-authored-by: dev' || CAST(o_custkey % 199 AS VARCHAR) ELSE '' END
  || CASE WHEN o_orderkey % 97 = 0 THEN ' resolve conflict' ELSE '' END AS message,
  o_orderkey AS okey, o_custkey AS custkey, CAST(o_orderdate AS TIMESTAMP) AS odate
FROM orders JOIN customer ON o_custkey = c_custkey),
fc_raw AS (
SELECT cb.commit_hash, cb.repo_name, cb.author,
  CASE WHEN l_linenumber % 7 = 1 THEN 'A' WHEN l_linenumber % 7 = 6 THEN 'D' WHEN l_linenumber % 7 = 0 THEN 'R' ELSE 'M' END AS change_type,
  CASE p_partkey % 10
    WHEN 0 THEN 'src/main/' || lower(p_type) || '/' || n || '.java'
    WHEN 1 THEN lower(p_type) || '/src/test/java/' || n || 'Test.java'
    WHEN 2 THEN 'web/' || lower(p_type) || '/' || n || '.ts'
    WHEN 3 THEN 'web/' || lower(p_type) || '/' || n || '.spec.ts'
    WHEN 4 THEN lower(p_type) || '/pom.xml'
    WHEN 5 THEN '.github/workflows/' || n || '.yml'
    WHEN 6 THEN 'docs/' || lower(p_type) || '/' || n || '.md'
    WHEN 7 THEN 'db/' || lower(p_type) || '/' || n || '.sql'
    WHEN 8 THEN 'lib/' || lower(p_type) || '/' || n || '.py'
    ELSE lower(p_type) || '/README.md' END AS file_path,
  CAST(round(l_quantity) AS BIGINT) AS additions, CAST(round(l_discount * 100) AS BIGINT) AS deletions
FROM lineitem JOIN commits_base cb ON l_orderkey = cb.okey
JOIN (SELECT *, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS n FROM part) p ON l_partkey = p_partkey),
file_changes AS (
SELECT *,
  {_flags_sql()}
FROM fc_raw),
rollup AS (
SELECT commit_hash, repo_name,
  SUM(CASE WHEN change_type IN ('A','M') THEN additions ELSE 0 END) AS a,
  SUM(CASE WHEN change_type IN ('A','M') THEN deletions ELSE 0 END) AS d,
  SUM(CASE WHEN change_type IN ('A','M') AND is_test_file = 1 THEN additions ELSE 0 END) AS at,
  SUM(CASE WHEN change_type IN ('A','M') AND is_test_file = 1 THEN deletions ELSE 0 END) AS dt,
  SUM(CASE WHEN change_type IN ('A','M') AND is_dot_file = 1 THEN additions ELSE 0 END) AS ad,
  SUM(CASE WHEN change_type IN ('A','M') AND is_dot_file = 1 THEN deletions ELSE 0 END) AS dd,
  SUM(CASE WHEN change_type IN ('A','M') AND is_build_file = 1 THEN additions ELSE 0 END) AS ab,
  SUM(CASE WHEN change_type IN ('A','M') AND is_build_file = 1 THEN deletions ELSE 0 END) AS db
FROM file_changes GROUP BY commit_hash, repo_name),
commits AS (
SELECT cb.commit_hash, cb.repo_name, cb.author, cb.date, cb.timezone, cb.is_merge,
  CAST(COALESCE(r.a, 0) AS BIGINT) AS total_additions, CAST(COALESCE(r.d, 0) AS BIGINT) AS total_deletions,
  CAST(COALESCE(r.at, 0) AS BIGINT) AS total_additions_test, CAST(COALESCE(r.dt, 0) AS BIGINT) AS total_deletions_test,
  CAST(COALESCE(r.ad, 0) AS BIGINT) AS total_additions_dot, CAST(COALESCE(r.dd, 0) AS BIGINT) AS total_deletions_dot,
  CAST(COALESCE(r.ab, 0) AS BIGINT) AS total_additions_build, CAST(COALESCE(r.db, 0) AS BIGINT) AS total_deletions_build,
  cb.message
FROM commits_base cb LEFT JOIN rollup r ON cb.commit_hash = r.commit_hash AND cb.repo_name = r.repo_name),
tags AS (
SELECT 'v' || CAST(o_orderkey AS VARCHAR) AS tag_name, c_mktsegment AS repo_name, 'c' || CAST(o_orderkey AS VARCHAR) AS tag_commit, 'Release' AS tag_message
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 300 = 0),
branches_base AS (
SELECT 'feature/' || CAST(custkey AS VARCHAR) AS branch_name, repo_name, min(odate) AS creation_date
FROM commits_base WHERE custkey % 10 = 0 GROUP BY custkey, repo_name),
branches AS (
SELECT b.branch_name, b.repo_name, CASE WHEN max(c.date) IS NULL THEN 1 ELSE 0 END AS is_active, b.creation_date, max(c.date) AS merge_date
FROM branches_base b LEFT JOIN commits_base c ON b.repo_name = c.repo_name AND c.is_merge = 1 AND instr(c.message, b.branch_name) > 0
GROUP BY b.branch_name, b.repo_name, b.creation_date),
parent_lags AS (
SELECT commit_hash, repo_name, is_merge, lag(commit_hash, 1) OVER w AS p1, lag(commit_hash, 2) OVER w AS p2
FROM commits_base WINDOW w AS (PARTITION BY repo_name ORDER BY date, commit_hash)),
commit_parents AS (
SELECT commit_hash, repo_name, p1 AS parent_hash FROM parent_lags WHERE p1 IS NOT NULL
UNION ALL SELECT commit_hash, repo_name, p2 FROM parent_lags WHERE is_merge = 1 AND p2 IS NOT NULL)"""


def commits_from(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    """Commits with their totals, summed per order before any commit is joined. Orders
    given twice have the changes of either, so a sum counts once for each order of its
    key in a repository (as it does for the file changes)."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", _change_type().alias("change_type"),
                                                 *[c.alias(n) for n, c in _lines().items()])
    parts = parts_from(spark, sf_dir)
    sums = li.join(parts, li.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(*rollup_exprs())
    orders = Window.partitionBy("_okey", "repo_name")
    times = F.when(F.col("repo_name").isNotNull(), F.count(F.lit(1)).over(orders))
    joined = commits.withColumn("_times", times).join(sums, F.col("_okey") == F.col("l_orderkey"), "left")
    return joined.withColumns({n: F.coalesce(F.col(n) * F.col("_times"), F.lit(0).cast("long")) for n in ROLLUPS}).select(
        *schema.COMMITS.fieldNames())


def lazy_index(spark: SparkSession, sf_dir: str, out: str) -> Tables:
    """The history tables, each written below ``out`` and read back when it is first
    asked for: a query pays for the tables that it reads."""
    base = f"{out.rstrip('/')}/{uuid.uuid4().hex}"
    cb = commits_base(spark, sf_dir)
    make = {"commits": lambda: commits_from(spark, sf_dir, cb), "file_changes": lambda: change_rows(spark, sf_dir, cb),
            "commit_parents": lambda: parents_from(cb), "branches": lambda: branches_from(cb),
            "tags": lambda: tags_from(spark, sf_dir)}

    def written(name: str) -> DataFrame:
        df = clustered(make[name](), name)
        write_table(file_changes_of(df) if name == "file_changes" else df, f"{base}/{name}")
        return read_table(spark, f"{base}/{name}", name)

    return Tables(**{n: lambda n=n: written(n) for n in NAMES})

