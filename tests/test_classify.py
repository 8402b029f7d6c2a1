"""Classifier flags on the path table of FIXTURES.md §4 (full-match semantics)."""

import re

import pytest

from vcscope.functions import classify

CASES = [
    ("src/main/java/A.java", 0, 0, 0, 0),
    ("src/test/java/ATest.java", 1, 0, 0, 0),
    ("src/test/java/ATests.java", 1, 0, 0, 0),
    ("ATests.java", 0, 0, 0, 0),
    ("web/x.spec.ts", 1, 0, 0, 0),
    ("latest/x/y.py", 1, 0, 0, 0),
    ("tests/test_x.py", 0, 0, 0, 0),
    ("pom.xml", 0, 1, 0, 0),
    ("lock.yaml.bak", 0, 0, 0, 0),
    ("conversion.js", 0, 1, 0, 0),
    ("myversion.jsx", 0, 0, 0, 0),
    ("myversion.js", 0, 1, 0, 0),
    (".github/workflows/ci.yml", 0, 1, 1, 0),
    (".gitignore", 0, 0, 1, 0),
    ("a..b", 0, 0, 1, 0),
    ("docs/x/guide.md", 0, 0, 0, 1),
    ("README.md", 0, 0, 0, 1),
]
FLAGS = ["is_test_file", "is_build_file", "is_dot_file", "is_documentation_file"]


def test_flags_in_spark(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "file_path string")
    got = {r["file_path"]: tuple(r[f] for f in FLAGS) for r in classify.with_flags(df).collect()}
    for path, *expected in CASES:
        assert got[path] == tuple(expected), path


@pytest.mark.parametrize("path,test,build,dot,doc", CASES)
def test_python_full_match_agrees(path, test, build, dot, doc):
    # the anchored alternation equals "any pattern fully matches"
    for name, want in zip(FLAGS, (test, build, dot, doc)):
        pats = classify.CLASSES[name]
        assert int(any(re.fullmatch(p, path) for p in pats)) == want
        assert int(bool(re.search(classify.full_match_regex(pats), path))) == want


def test_vocabularies_of_operators_and_oracle_are_one():
    from vcscope.functions import vocab
    from vcscope.plans import oracle
    oracle.oracle_sql()
    from vcscope.plans import oracle_bodies as o
    assert o.BUG_RE.split("|") == vocab.BUG_KEYWORDS
    assert set(o.MAINT_RE.split("|")) == set(vocab.BUG_KEYWORDS + vocab.IMPROVEMENT_KEYWORDS)
    assert all(f"'{e}'" in oracle.BODIES["configuration_commits"] for e in vocab.CONFIG_EXTENSIONS)
    assert all(w in oracle.BODIES["configuration_commits"] for w in vocab.CONFIG_KEYWORDS)
    assert all(n.replace(".", "[.]") in oracle.BODIES["build_file_activity"] for n in vocab.BUILD_NAMES)


def test_required_literals():
    assert classify.required_literal(r".*Test\.(java|kt)$") == "Test."
    assert classify.required_literal(r".*lock.json$") in ("lock", "json")
    assert classify.required_literal(classify.DOT_FILE_PATTERN) == "."
    assert classify.required_literal(r"ab?c+") == ""  # unknown: nothing is required
