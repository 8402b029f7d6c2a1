"""Every metric by repository equals the metric over each repository's own tables."""

import os
import sys
from collections import Counter

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

OTHERS = ("ingest", "adhoc", "delimited", "report", "data_quality", "release_churn_", "release_commit_count")


def _names():
    import vcscope.operators  # noqa: F401
    from vcscope.operators.scoped import BY_REPO
    from vcscope.plans.catalog import REGISTRY
    # The rest of BY_REPO are catalogue keys and compared there.
    return [n for n in REGISTRY if not n.startswith(OTHERS) and not n.endswith(("_between", "_by_repo"))
            and n not in BY_REPO]


def test_metrics_by_repo_match_oracle(spark):
    from oracle_check import canon, duck
    from vcscope.plans import catalog, oracle
    from vcscope.sources.fixtures import duckdb_views
    oracle.oracle_sql()
    t, con, views = catalog.index_tables(spark, SF_SMALL).by_repo(), duck(SF_SMALL), duckdb_views()
    bad = {}
    for name in _names():
        df = catalog.REGISTRY[name](t)
        cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
        want = Counter()
        for repo in oracle.REPOS:
            cur = con.execute(oracle.combine(oracle.scoped_views(views, f"repo_name = '{repo}'"), oracle.BODIES[name]))
            names, rows = [d[0] for d in cur.description], cur.fetchall()
            if "repo_name" not in names:
                names, rows = [*names, "repo_name"], [(*r, repo) for r in rows]
            own_cols, own = canon(names, rows)
            want += own
        if cols != own_cols or got != want:
            bad[name] = (cols, own_cols, list((got - want).items())[:2], list((want - got).items())[:2])
    assert not bad, bad


def test_equal_paths_of_two_repositories_stay_apart(spark):
    from vcscope.plans import catalog
    t = catalog.index_tables(spark, SF_SMALL)
    paths = t.file_changes.select("file_path", "repo_name").distinct()
    shared = paths.groupBy("file_path").count().where("count > 1").count()
    assert shared > 0, "the tables have no path in two repositories"
    assert catalog.REGISTRY["code_ownership_files"](t.by_repo()).count() == paths.count()
    assert catalog.REGISTRY["code_ownership_files"](t).count() == paths.select("file_path").distinct().count()


@pytest.mark.parametrize("name", ["bus_factor_modules", "code_ownership_modules", "expertise"])
def test_no_window_over_a_whole_module(spark, name):
    from vcscope.plans import catalog
    t = catalog.index_tables(spark, SF_SMALL)
    for tables in (t, t.by_repo()):
        plan = catalog.REGISTRY[name](tables)._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window " in x and "[" in x]
        assert all("_part" in x for x in windows)


def test_handles_of_other_scopes_derive_their_own(spark):
    from vcscope.operators.collab import pair_index
    from vcscope.plans import catalog
    t = catalog.index_tables(spark, SF_SMALL)
    assert pair_index(t) is pair_index(t)
    one = t.of_repos("BUILDING")
    assert "pair-index" not in one.derived and pair_index(one).count() < pair_index(t).count()
    assert pair_index(t.by_repo()) is not pair_index(t)
