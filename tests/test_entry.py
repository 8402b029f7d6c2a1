"""The driver's entry works where the corpus operations have been removed."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT


@pytest.mark.parametrize("gone", [["vcscope/llm", "tests/llm"], ["vcscope/llm", "tests/llm", "corpus_pipeline.py"],
                                  ["corpus_pipeline.py"]])
def test_entry_without_corpus_operations(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in gone])
    code = ("import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
            "import vcscope.plans.catalog as c; print(len(c.queries()), len(q), len(set(o) - set(q)), 'pipeline' in q)")
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    core, all_, unknown, pipeline = out.stdout.split()[-4:]
    assert int(core) > 130 and unknown == "0" and pipeline == "False"
    if "vcscope/llm" in gone:
        assert all_ == core


def test_errors_inside_are_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (tmp_path / "repo/vcscope/llm").mkdir()
    (tmp_path / "repo/vcscope/llm/__init__.py").write_text("")
    (tmp_path / "repo/vcscope/llm/registry.py").write_text("from . import nothing_there\n")
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo",
                         capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode != 0 and "nothing_there" in out.stderr
