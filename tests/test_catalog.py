"""Every catalogue query against its DuckDB oracle (the driver's check), plus
the smoke entry and structural properties."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["author", "num_commits", "total_deletions", "total_additions"]


def test_every_query_has_oracle():
    import __spark_entry__ as entry
    from vcscope.plans import catalog
    from vcscope.plans.oracle import oracle_sql
    assert set(catalog.queries()) == set(oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_queries_match_oracle(spark):
    from oracle_check import compare
    from vcscope.plans import catalog
    res = compare(spark, SF_SMALL, sorted(catalog.queries()), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad


def test_properties(spark):
    from vcscope.plans import catalog
    t = catalog.index_tables(spark, SF_SMALL)
    import vcscope.operators  # noqa: F401
    from vcscope.operators.authors import ownership
    from vcscope.operators.releases import _commits_in_releases
    from vcscope.operators.reports import report_churn
    # per-author churn sums to the total
    total = t.commits.agg(F.sum("total_additions")).first()[0]
    assert report_churn(t).agg(F.sum("total_additions")).first()[0] == total
    # ownership shares sum to 1 per file
    s = ownership(t, "file").groupBy("unit").agg(F.sum("share").alias("s")).where(F.abs(F.col("s") - 1) > 1e-5)
    assert s.count() == 0
    # release windows are disjoint: each commit lies in at most one
    j = _commits_in_releases(t, "inner", first=True)
    assert j.groupBy("commit_hash").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["collaboration_network", "change_coupling", "time_between_commits",
                                  "release_churn_top", "temporal_coupling"])
def test_no_cartesian_plans(spark, name):
    from vcscope.plans import catalog
    df = catalog.run(name, spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
