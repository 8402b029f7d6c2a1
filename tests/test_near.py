"""Files changed near each other by one author: against brute force, and what is shuffled."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest

from vcscope import schema
from vcscope.operators import collab, near
from vcscope.tables import Tables

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """A bot's busy days, a file of nearly all commits, equal names in two repositories, a commit
    given twice, one given with two dates, a change given twice, and nulls."""
    r = random.Random(3)
    commits, changes = [], []
    for k in range(260):
        repo, author = f"r{k % 2}", "bot" if k % 3 else f"dev{r.randrange(4)}"
        commits.append((repo, f"c{k // 2}", BASE + dt.timedelta(seconds=r.randrange(9) * 43200 + r.randrange(2))))
        for path in {*(["README"] if k % 5 else []), *(f"f{r.randrange(30)}" for _ in range(3))}:
            changes.append((repo, f"c{k // 2}", author, path))
    commits += [commits[7], ("r0", "c8", BASE + dt.timedelta(days=30)), ("r0", "c9", None), (None, "c1", BASE)]
    changes += changes[:9] + [("r0", "c8", None, "f1"), ("r0", "c8", "bot", None), ("r0", None, "bot", "f2")]
    made = {"commits": spark.createDataFrame(commits, "repo_name string, commit_hash string, date timestamp"),
            "file_changes": spark.createDataFrame(
                changes, "repo_name string, commit_hash string, author string, file_path string")}
    empty = {n: spark.createDataFrame([], schema.ALL[n]) for n in ("commit_parents", "branches", "tags")}
    return Tables(**made, **empty), commits, changes


@pytest.mark.parametrize("scoped, pairs, block", [(False, 1 << 21, 10**6), (True, 1 << 21, 10**6), (False, 50, 100)])
def test_temporal_coupling_by_brute_force(history, scoped, pairs, block, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", pairs)
    monkeypatch.setattr(near, "BLOCK_CHANGES", block)
    monkeypatch.setattr(near, "ROWS", 64)
    t, commits, changes = history
    events = [(r if scoped else "", a, f, (r, c), when) for r, c, a, f in set(changes) if None not in (r, c, a, f)
              for repo, h, when in commits if (repo, h) == (r, c) and when]
    want = Counter((x[0], x[2], y[2]) for x in events for y in events if x[:2] == y[:2] and x[3] != y[3]
                   and x[2] < y[2] and abs((x[4] - y[4]).total_seconds()) <= 86400)
    t = t.by_repo() if scoped else t
    for least in (1, 2, 9):
        got = collab.temporal_coupling(t, min_support=least).collect()
        named = {(r.repo_name if scoped else "", r.file_a, r.file_b): r.co_changes for r in got}
        assert named == {k: n for k, n in want.items() if n >= least} and len(got) == len(named) > 50


def test_no_changes(spark, history):
    t = history[0]
    empty = Tables(**t.as_dict() | {n: getattr(t, n).where("false") for n in ("commits", "file_changes")})
    assert collab.temporal_coupling(empty).collect() == []


def test_dense_and_sparse_counts(monkeypatch):
    """A file with more pairs than a task holds at once is counted in parts, rare ones by sorting."""
    r = np.random.default_rng(1)
    no = np.where(r.random(3000) < 0.3, 0, r.integers(1, 900, 3000))
    parts = {"at": [r.integers(0, 50_000, 3000)], "commit": [r.integers(0, 1500, 3000)], "no": [no]}
    x = near.Side(parts)
    close = (np.abs(x.at[:, None] - x.at) <= 700) & (x.commit[:, None] != x.commit) & (x.file[:, None] < x.file)
    want = Counter(zip(*(x.file[i].tolist() for i in np.nonzero(close))))
    for pairs in (500, 20_000, 10**7):
        monkeypatch.setattr(near, "PAIRS", pairs)
        got = {}
        for a, b, n in near._meetings(x, x, 700, 2):
            got |= dict(zip(zip(a.tolist(), b.tolist()), n.tolist()))
        assert got == {k: n for k, n in want.items() if n > 1}


def test_pairs_of_files_are_not_shuffled(history):
    """Before, every pair of near changes was a joined row, grouped by its two files and named by joins."""
    plan = collab.temporal_coupling(history[0])._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Repartition" not in above and "Join" not in above
