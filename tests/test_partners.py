"""Author pairs found in blocks: against brute force, and what their plans shuffle."""

import itertools
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vcscope import schema
from vcscope.operators import collab
from vcscope.tables import Tables


def history(spark, rows):
    """Tables of (repo, commit, author, path) rows."""
    named = [dict(zip(("repo_name", "commit_hash", "author", "file_path"), r)) for r in rows]
    text = "repo_name string, commit_hash string, author string, file_path string"
    changes = spark.createDataFrame([tuple(r.values()) for r in named], text)
    commits = spark.createDataFrame([(r, h) for r, h in sorted({x[:2] for x in rows})], "repo_name string, commit_hash string")
    empty = {n: spark.createDataFrame([], schema.ALL[n]) for n in ("commit_parents", "branches", "tags")}
    return Tables(commits=commits, file_changes=changes, **empty)


@pytest.fixture(scope="module")
def rows():
    """A file of nearly all authors, files of a few, files of one; two repositories
    with equal names; an author and a path that are not known; rows that come twice."""
    r = random.Random(5)
    out = []
    for k in range(500):
        repo, author = f"r{k % 2}", f"dev{r.randrange(90)}"
        for path in {"README", *(f"f{r.randrange(40)}" for _ in range(3))} if k % 3 else {f"f{k % 40}", f"own{k}"}:
            out.append((repo, f"c{k}", author, path))
    return out + out[:20] + [("r0", "c1", None, "README"), ("r0", "c1", "dev1", None)]


def expected(rows, scope=()):
    """Shared files by pair, and required and congruent pairs at support 5, of each scope."""
    rows = [(r if scope else "", r, c, a, f) for r, c, a, f in rows]
    files, commits, shared, need = {}, {}, Counter(), set()
    for s, r, c, a, f in rows:
        if f is not None:
            files.setdefault((s, f), set()).add(a)
            commits.setdefault((r, c), set()).add((s, f))
    for (s, _), who in files.items():
        shared.update((s, *p) for p in itertools.combinations(sorted(who - {None}), 2))
    support = Counter(p for fs in commits.values() for p in itertools.combinations(sorted(fs), 2))
    for (f, g), n in support.items():
        if n >= 5:
            need |= {(f[0], *sorted((a, b))) for a in files[f] for b in files[g] if a and b and a != b}
    return shared, need


@pytest.mark.parametrize("scoped", [False, True])
def test_partners_by_brute_force(spark, rows, scoped, monkeypatch):
    from vcscope.operators import partners
    monkeypatch.setattr(partners, "ROWS", 100)
    t = history(spark, rows)
    t = t.by_repo() if scoped else t
    shared, need = expected(rows, scoped)
    scope = (lambda r: r.repo_name) if scoped else (lambda r: "")
    got = {(scope(r), r.author_a, r.author_b): r.shared_files for r in collab.collaboration_network(t).collect()}
    assert got == shared and len(got) > 2000
    degree, weight = Counter(), Counter()
    for (s, a, b), n in shared.items():
        for x in (a, b):
            degree[s, x] += 1
            weight[s, x] += n
    got = {(scope(r), r.author): (r.degree, r.weighted_degree) for r in collab.network_degree(t).collect()}
    assert got == {k: (degree[k], weight[k]) for k in degree}
    got = {scope(r): (r.required_pairs, r.congruent_pairs) for r in collab.socio_technical_congruence(t).collect()}
    assert got == {s: (len([p for p in need if p[0] == s]), len([p for p in need if p[0] == s and p in shared]))
                   for s in ({"r0", "r1"} if scoped else {""})} and need


def test_long_lists_and_short(spark):
    """Unions take lists as bits from a 32nd of the authors on, and pairs are counted either way."""
    from vcscope.operators import partners
    r = random.Random(1)
    lists = [r.sample(range(2000), k) for k in [1800, 900, 70, 60, 20, 5, 3, 2] * 3]
    df = spark.createDataFrame([(x,) for x in lists], "authors array<int>")
    times = Counter(p for x in lists for p in itertools.combinations(sorted(x), 2))
    got = partners.shared(df, 2000)
    assert got.agg(F.count(F.lit(1)), F.sum("shared_files")).first()[:] == (len(times), sum(times.values()))
    degree, weight = Counter(), Counter()
    for p, n in times.items():
        degree.update(p)
        weight.update({p[0]: n, p[1]: n})
    assert {x.no: (x.degree, x.weighted_degree) for x in partners.degrees(df, 2000).collect()} == {
        a: (degree[a], weight[a]) for a in degree}


def test_pairs_come_by_stretches_of_partners(spark, monkeypatch):
    """Before, an author's pairs followed each other whatever the number of partners: a writer met
    a new name in each row and stored it as text (5.5 bytes a pair instead of two)."""
    from vcscope.operators import partners
    monkeypatch.setattr(partners, "PARTNERS", 64)
    r = random.Random(2)
    lists = [r.sample(range(700), k) for k in [600, 300, 40, 9, 8, 3, 2] * 6]
    got = partners.shared(spark.createDataFrame([(x,) for x in lists], "authors array<int>"), 700)
    times = Counter(p for x in lists for p in itertools.combinations(sorted(x), 2))
    rows = got.select(F.spark_partition_id().alias("task"), "*").collect()
    assert {(x.a, x.b): x.shared_files for x in rows} == times and len(rows) == len(times)
    for task, own in itertools.groupby(rows, key=lambda x: x.task):
        stretches = [x.b // 64 for x in own]
        assert stretches == sorted(stretches) and len(set(stretches)) > 5


def test_pairs_of_authors_are_not_shuffled(spark, rows):
    """Before, pairs went to (author, author), or 4 KB for each author of a file."""
    t = history(spark, rows)
    for query in (collab.collaboration_network, collab.network_degree):
        plan = query(t)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("MapInArrow")]
        assert "Aggregate" not in above and "Repartition" not in above and "bitmap" not in plan


def test_blocks_follow_what_they_are_sent(spark, monkeypatch):
    """Before, there were two blocks a shuffle partition, and short lists went to nearly as many as they are long."""
    from vcscope.operators import partners
    monkeypatch.setattr(partners, "BLOCK_NUMBERS", 100)
    df = spark.createDataFrame([(list(range(4)), None), (list(range(40)), [1, 2])], "authors array<int>, more array<int>")
    count = lambda columns, to, least=2: partners.block_count(df, columns, to, least)
    # 44 numbers in 2 blocks are sent twice; with ``more`` 46; lists are sent to 8 blocks at most 4 and 8 times.
    assert count(["authors"], ("authors",)) == 2 and count(["authors"], ("authors",), 16) == 16
    monkeypatch.setattr(partners, "BLOCK_NUMBERS", 41)
    assert count(["authors"], ("authors",)) == 16 and count(["authors", "more"], ("authors",)) == 64
    assert partners.block_count(df.where("false"), ["authors"], ("authors",), 6) == 6


def test_files_of_a_commit_move_once(spark, rows):
    """Before, distinct changes were found twice, numbered, counted and joined with themselves."""
    more = [("r0", None, "dev1", "f1"), ("r0", "c2", "dev1", "f2")]
    t = history(spark, rows)
    t = replace(t, file_changes=t.file_changes.unionByName(spark.createDataFrame(
        [(r, c, a, f) for r, c, a, f in more], "repo_name string, commit_hash string, author string, file_path string")))
    pairs = collab._supports(t, 2)
    lists = collab.commit_files(t, 2).collect()
    numbers = {r.no: r.file_path for r in collab.file_numbers(t).collect()}
    changed, often = {}, Counter(r[3] for r in rows + more)
    for r, c, _, f in rows + more:
        if f and often[f] > 1:
            changed.setdefault((r, c), set()).add(f)
    assert {(x.repo_name, x.commit_hash): {numbers[f] for f in x.files} for x in lists} == changed
    want = Counter(p for (_, c), fs in changed.items() if c for p in itertools.combinations(sorted(fs), 2))
    assert {tuple(sorted((numbers[x.a], numbers[x.b]))): x.support for x in pairs.collect()} == want and want
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_long_lists(spark):
    lists = [sorted(random.Random(k).sample(range(900), k)) for k in (1, 2, 9, 10, 11, 35, 60)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "g long, l array<long>")
    got = sorted(tuple(r) for r in collab.pairs_of(df, "l", ["g"], block=10).collect())
    assert got == sorted((k, a, b) for k, x in enumerate(lists) for a, b in itertools.combinations(x, 2))
