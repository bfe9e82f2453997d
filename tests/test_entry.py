"""The entry module on a copy of the repository without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def _names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [set(line.split()) for line in said.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("gone", [["parcelry/llm"], ["corpus_pipeline.py"], ["parcelry/llm", "corpus_pipeline.py"]])
def test_entry_without_text_operators(tmp_path, gone):
    from parcelry.plans.catalog import catalog

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    queries, sqls = _names(copy)
    assert set(catalog()) <= queries
    assert "pipeline" not in queries
    if "parcelry/llm" in gone:
        assert queries == set(catalog())
    assert sqls <= queries


def test_other_missing_modules_are_errors(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "session.py"))
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "parcelry.session" in said.stderr
