"""Log, branch and tag dump parsing on hand-written dumps (FIXTURES.md §2–3)."""

import datetime as dt
import os
import random
import tempfile

import pytest

from vcscope.sources import gitlog, refs
from vcscope.sources.ingest import ingest

T = "\t"
LOG = f"""commit:aaa3
author:Ann
date:2024-01-03T10:00:00+02:00 
parents:aaa1 aaa2
message:
Merge branch feature-x

numstat:
commit:aaa2
author:Bob
date:2024-01-02T10:00:00Z 
parents:aaa1
message:
Fix bug
body line
date: 1999-01-01T00:00:00Z

numstat:

:100644 100644 111 222 M{T}src/a.java
:000000 100644 000 333 A{T}logo.png
:100644 100644 444 555 R090{T}lib/old.py{T}lib/new.py
:000000 100644 000 333 A{T}docs/my file.md
3{T}1{T}src/a.java
-{T}-{T}logo.png
2{T}2{T}lib/{{old.py => new.py}}
7{T}0{T}docs/my file.md
commit:aaa1
author:Ann
date:2024-01-01T10:00:00-05:00 
parents:
message:
init
numstat:

:000000 100644 000 333 A{T}README.md
10{T}0{T}README.md
commit:aaa4
author:Cy
date:2024-01-04T10:00:00+05:30 
parents:aaa3
message:
merge feature/12 into main

numstat:
"""
BRANCHES = """feature-x,2023-12-30T10:00:00Z
origin/feature-x,2023-12-01T10:00:00Z
feature/12,2023-12-31T10:00:00Z
wip,2024-01-02T00:00:00Z
"""
MERGED = """* feature-x
  remotes/origin/feature-x
  remotes/origin/HEAD -> origin/main
  main
  domain
  feature/12
"""
NO_MERGED = """  wip
  feature/12
"""
TAGS = """v1,aaa1,,2024-01-01T10:00:00Z,first, with comma
v2,bbbb,aaa3,2024-01-03T10:00:00Z,
broken line
"""


@pytest.fixture(scope="module")
def dumps():
    d = tempfile.mkdtemp(prefix="vcscope-dumps-")
    for name, text in (("demo.log", LOG), ("demo.branches", BRANCHES), ("demo.merged", MERGED),
                       ("demo.no-merged", NO_MERGED), ("demo.tags", TAGS)):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    return d


def test_commits(spark, dumps):
    t = ingest(spark, dumps)
    c = {r["commit_hash"]: r for r in t.commits.collect()}
    assert set(c) == {"aaa1", "aaa2", "aaa3", "aaa4"}
    assert c["aaa3"]["is_merge"] == 1 and c["aaa2"]["is_merge"] == 0
    assert c["aaa1"]["date"] == dt.datetime(2024, 1, 1, 15, 0, 0)
    assert c["aaa1"]["timezone"] == "-05:00" and c["aaa2"]["timezone"] == "Z"
    assert c["aaa4"]["timezone"] == "+05:30"
    # body line that looks like a header does not overwrite the date
    assert c["aaa2"]["date"] == dt.datetime(2024, 1, 2, 10, 0, 0)
    assert c["aaa2"]["message"] == "Fix bug\nbody line\ndate: 1999-01-01T00:00:00Z"
    # totals over A and M only: M 3/1 + A 0/0 (binary) + A 7/0; the rename is not counted
    assert (c["aaa2"]["total_additions"], c["aaa2"]["total_deletions"]) == (10, 1)
    assert c["aaa2"]["total_additions_dot"] == 0
    assert (c["aaa3"]["total_additions"], c["aaa3"]["total_deletions"]) == (0, 0)


def test_file_changes(spark, dumps):
    t = ingest(spark, dumps)
    fc = {r["file_path"]: r for r in t.file_changes.where("commit_hash = 'aaa2'").collect()}
    assert set(fc) == {"src/a.java", "logo.png", "lib/old.py", "docs/my file.md"}
    assert (fc["src/a.java"]["additions"], fc["src/a.java"]["deletions"]) == (3, 1)
    assert (fc["logo.png"]["additions"], fc["logo.png"]["deletions"]) == (0, 0)
    r = fc["lib/old.py"]
    assert (r["change_type"], r["similarity"], r["new_path"], r["additions"]) == ("R", 90, "lib/new.py", 2)
    assert fc["docs/my file.md"]["is_documentation_file"] == 1
    ids = [x["id"] for x in t.file_changes.collect()]
    assert len(ids) == len(set(ids))


def test_parents(spark, dumps):
    t = ingest(spark, dumps)
    edges = sorted((r["commit_hash"], r["parent_hash"]) for r in t.commit_parents.collect())
    assert edges == [("aaa2", "aaa1"), ("aaa3", "aaa1"), ("aaa3", "aaa2"), ("aaa4", "aaa3")]


def test_branches(spark, dumps):
    t = ingest(spark, dumps)
    b = {r["branch_name"]: r for r in t.branches.collect()}
    assert set(b) == {"feature-x", "feature/12", "wip"}  # main, domain, HEAD alias dropped
    assert b["feature-x"]["is_active"] == 0
    assert b["feature-x"]["creation_date"] == dt.datetime(2023, 12, 30, 10, 0, 0)  # first line wins
    # first commit in log order whose message contains the name
    assert b["feature-x"]["merge_date"] == dt.datetime(2024, 1, 3, 8, 0, 0)
    assert b["feature/12"]["is_active"] == 0  # in both lists: merged wins
    assert b["feature/12"]["merge_date"] == dt.datetime(2024, 1, 4, 4, 30, 0)
    assert b["wip"]["is_active"] == 1 and b["wip"]["merge_date"] is None


def test_tags(spark, dumps):
    t = ingest(spark, dumps)
    tags = {r["tag_name"]: r for r in t.tags.collect()}
    assert set(tags) == {"v1", "v2"}
    assert tags["v1"]["tag_commit"] == "aaa1" and tags["v1"]["tag_message"] == "first, with comma"
    assert tags["v2"]["tag_commit"] == "aaa3" and tags["v2"]["tag_message"] == ""


def test_table_roundtrip(spark, dumps, tmp_path):
    from vcscope.tables import Tables
    t = ingest(spark, dumps)
    t.write(str(tmp_path / "store"))
    back = Tables.read(spark, str(tmp_path / "store"))
    assert back.commits.count() == 4
    assert back.file_changes.count() == t.file_changes.count()
    assert back.commits.columns == t.commits.columns


def test_streaming_index(spark, dumps, tmp_path):
    from vcscope.streaming.logstream import start_log_indexing
    q = start_log_indexing(spark, dumps, str(tmp_path / "out"), str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "commits"))
    assert got.count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "file_changes")).count() == 5


def test_streaming_index_keeps_the_first_record_of_a_hash(spark, tmp_path):
    from vcscope.streaming.logstream import start_log_indexing

    def run():
        start_log_indexing(spark, str(tmp_path / "d*"), str(tmp_path / "out"), str(tmp_path / "ckpt"),
                           once=True).awaitTermination(120)
        return sorted((r.commit_hash, r.author) for r in spark.read.parquet(str(tmp_path / "out" / "commits")).collect())

    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "demo.log").write_text(LOG)
    first = run()
    (tmp_path / "d2").mkdir()
    # The whole log again, with another author, and a commit that is new.
    again = LOG.replace("author:", "author:Not ")
    (tmp_path / "d2" / "demo.log").write_text(again + again[:again.index("commit:", 10)].replace("commit:aaa3", "commit:aaa9"))
    got = run()
    assert len(first) == 4 and len(got) == 5 and set(first) < set(got)
    assert {h for h, _ in set(got) - set(first)} == {"aaa9"}
    changes = spark.read.parquet(str(tmp_path / "out" / "file_changes"))
    assert changes.where("commit_hash = 'aaa2'").count() == changes.where("commit_hash = 'aaa2'").distinct().count()


def test_sinks(spark, tmp_path):
    from vcscope.sources.sinks import write_delimited
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    write_delimited(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == ["x, n", "a, 1", ", 2"]


HARD = f"""garbage before any record
commit:bbb1
author:Ann
date:2024-01-03T10:00:00Z
parents:
message:
revert something
commit: see aaa0 for why
commit:nothex either

numstat:

:100644 100644 111 222 M{T}a.txt
:100644 100644 111 222 M{T}a.txt
4{T}1{T}a.txt
9{T}9{T}a.txt
commit:bbb2
author:Bob
date:
parents:bbb1
message:
no date
numstat:

:000000 100644 000 333 A{T}b.py
6{T}0{T}b.py
commit:bbb1
author:Ann
date:2024-01-03T10:00:00Z
parents:
message:
the same hash again
numstat:

:000000 100644 000 333 A{T}again.py
50{T}0{T}again.py
"""


def test_hard_records(spark, tmp_path):
    from vcscope.sources.ingest import index
    from vcscope.tables import data_folder
    (tmp_path / "d").mkdir()
    for name, text in (("hard.log", HARD), ("hard.branches", "x,not a date\n"), ("hard.merged", "x\n"),
                       ("hard.no-merged", ""), ("hard.tags", "")):
        (tmp_path / "d" / name).write_text(text)
    t = index(spark, str(tmp_path / "d"), str(tmp_path / "store"))
    c = {r.commit_hash: r for r in t.commits.collect()}
    assert set(c) == {"bbb1", "bbb2"} and t.commits.count() == 2
    assert c["bbb1"].message == "revert something\ncommit: see aaa0 for why\ncommit:nothex either"
    assert (c["bbb1"].total_additions, c["bbb1"].total_deletions) == (8, 2)  # the first counts, twice
    assert c["bbb2"].date is None and c["bbb2"].total_additions == 6
    assert sorted(r.file_path for r in t.file_changes.collect()) == ["a.txt", "a.txt", "b.py"]
    assert len({r.id for r in t.file_changes.collect()}) == 3
    rejects = {r.reason: r.text for r in spark.read.parquet(data_folder(spark, str(tmp_path / "store")) + "/rejects").collect()}
    assert rejects == {"no record header": "garbage before any record", "unreadable date": "bbb2 "}
    assert t.branches.first().creation_date is None


def test_parse_shuffles_for_repeated_records_only(spark):
    records = spark.createDataFrame([], "repo_name string, ordinal struct<file_name:string,row:long>, record string")
    plan = gitlog.parse_commits(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_parsed_records_are_not_sorted_to_find_repeated_ones(spark):
    rows = [("r", ("f", n), f"{h}\nauthor:A\nmessage:\nm{n}\n\nnumstat:\n") for n, h in enumerate(["abc1", "abc2", "abc1"])]
    records = spark.createDataFrame(rows, "repo_name string, ordinal struct<file_name:string,row:long>, record string")
    parsed = gitlog.parse_commits(records)
    assert "min_by" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.commit_hash, r.message) for r in parsed.collect()) == [("abc1", "m0"), ("abc2", "m1")]


def test_bodies_are_put_back_where_files_are_read(spark, tmp_path, monkeypatch):
    """Records are not written as text but at the edges of a file's blocks, whatever batch or block
    a body's pieces are in. Before, all texts were written twice and joined with their bodies."""
    r, text, want = random.Random(4), "", {"no record yet": 0}
    for k in range(400):
        pieces = [f" piece {k}.{i} " + "x" * r.randrange(60) for i in range(r.choice([0, 0, 0, 1, 2, 30]))]
        body = "\ncommit:".join([f"m{k}", *pieces])
        want[f"{k:04x}"] = "\n".join(x for x in body.split("\n") if x.strip()).strip()
        text += f"commit:{k:04x}\nauthor:A\ndate:2024-01-01T00:00:00Z\nparents:\nmessage:\n{body}\n\nnumstat:\n\n"
    del want["no record yet"]
    for name in ("one.log", "two.log"):
        (tmp_path / name).write_text(f"commit: lost\ncommit: lost too\n{text}")
    texts, staged = [], gitlog.staged
    monkeypatch.setattr(gitlog, "staged", lambda df, name: texts.append((name, staged(df, name))) or texts[-1][1])
    conf = {"spark.sql.files.maxPartitionBytes": "6000", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        parsed, rejects = gitlog.parse_log(spark, str(tmp_path))
        got = {(x.repo_name, x.commit_hash): x.message for x in parsed.collect()}
        assert got == {(n, h): m for n in ("one", "two") for h, m in want.items()} and parsed.count() == 800
        assert sorted((x.repo_name, x.text.strip()) for x in rejects.collect()) == [
            (n, x) for n in ("one", "two") for x in ("commit: lost".removeprefix("commit:").strip(), "lost too")]
        size = sum(len(x._text or "") for x in dict(texts)["log-parsed"].select("_text").collect())
        assert 0 < size < len(text) and "log-fragments" not in dict(texts) and "log-records" not in dict(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
