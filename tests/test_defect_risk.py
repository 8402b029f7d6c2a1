"""Defect risk: what its shuffles carry."""

from vcscope.operators import bugs
from vcscope.schema import ALL
from vcscope.tables import Tables


def test_no_row_is_repeated_for_distinct_counts(spark, monkeypatch):
    """Changes were repeated for each distinct count, with their paths."""
    commits = spark.sql("""SELECT * FROM VALUES ('a', 'r', timestamp'2020-01-01', 'x'), ('b', 'r', timestamp'2020-01-02', 'x'),
        ('z', 'r', timestamp'2021-01-01', 'fix bug'), ('z', 'q', timestamp'2021-01-01', 'fix bug'),
        ('y', 'r', timestamp'2021-01-01', 'x') AS t(commit_hash, repo_name, date, message)""")
    changes = spark.sql("""SELECT *, 1L AS additions, 2L AS deletions FROM VALUES ('a', 'r', 'p', 'f'), ('a', 'r', 'p', 'f'),
        ('b', 'r', 'o', 'f'), ('b', 'r', 'p', 'f'), ('b', 'r', null, 'f'), ('z', 'r', 'p', 'f'), ('z', 'r', 'o', 'f'),
        ('z', 'q', 'p', 'f'), ('y', 'r', 'p', 'f'), ('z', 'r', 'p', 'late'), ('a', 'r', 'p', null)
        AS t(commit_hash, repo_name, author, file_path)""")
    empty = {n: spark.createDataFrame([], ALL[n]) for n in ("commit_parents", "branches", "tags")}
    t = Tables(commits=commits, file_changes=changes, **empty)
    plans, staged = [], bugs.staged
    monkeypatch.setattr(bugs, "staged", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    rows = [r[:] for r in bugs.defect_risk(t).collect()]
    assert rows == [("f", 5, 15, 2, 1.0, 2)]
    assert plans and "Expand" not in plans[0]
    by_repo = [(r.repo_name, r.file_path, r.fixes_after) for r in bugs.defect_risk(t.by_repo()).collect()]
    assert by_repo == [("q", "f", 0), ("r", "f", 1)]  # the only commit of q lies at its cut
