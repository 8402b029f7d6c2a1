"""The gram index finds what a scan finds, and reads little for it."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vcscope.operators.other import keyword_search
from vcscope.operators.search import GRAM, candidates, index_of, search
from vcscope.tables import Tables


@pytest.fixture(scope="module")
def tables(spark):
    from vcscope.plans import catalog
    return catalog.index_tables(spark, SF_SMALL)


def pairs(df):
    rows = [(r.repo_name, r.commit_hash) for r in df.select("repo_name", "commit_hash").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("terms", [["conflict", "readme"], ["fi"], ["x"], ["/"], ["Fix", "POM.xml"], ["no such thing"],
                                   [".py", "q"], ["src/main"], [""], ["a.c"]])
def test_search_equals_the_scan(tables, terms):
    want = keyword_search(tables, [x.lower() for x in terms]) if any(terms) else tables.commits.limit(0)
    assert pairs(search(tables, terms)) == pairs(want)


def test_texts_shorter_than_a_gram(spark, tables):
    texts = F.array(*map(F.lit, ["ab", "b", "xaby", "Éa"]))
    c = tables.commits.limit(4).withColumn("message", F.element_at(texts, F.row_number().over(Window.orderBy("commit_hash"))))
    small = Tables(c.cache(), tables.file_changes.limit(0), tables.commit_parents, tables.branches, tables.tags)
    for terms in (["ab"], ["b"], ["aby"], ["éa"], ["É"], ["abz"]):
        assert pairs(search(small, terms)) == pairs(keyword_search(small, [x.lower() for x in terms])), terms


def test_reads_are_pruned(spark, tables, tmp_path):
    tables.write(str(tmp_path / "store"), search=True)
    t = Tables.read(spark, str(tmp_path / "store"))
    assert t.search and t.of_repos("BUILDING").search is None
    _, postings = index_of(t)
    term = "conflict"
    plan = candidates(postings, term)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    # Postings are in the order of grams: few files hold a term's.
    files = {f for g in range(len(term) - GRAM + 1) for f in
             [r.f for r in postings.where(F.col("gram") == term[g:g + GRAM]).select(
                 F.input_file_name().alias("f")).distinct().collect()]}
    assert 0 < len(files) < len(postings.inputFiles())
    lists = postings.agg(F.max(F.size("nos")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    assert lists.n <= 32_768 and lists.rows == postings.select("gram", "block").distinct().count()
    assert pairs(search(t, [term])) == pairs(keyword_search(tables, [term]))
