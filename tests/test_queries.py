"""Every registered query against its SQL twin on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
import check
from threadloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_registry_is_complete():
    assert set(queries.RUNS) == set(queries.SQL)
    assert __spark_entry__.queries().keys() >= queries.RUNS.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "category", "text"]


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_entry_imports_without_the_operators_for_training_text(tmp_path, pipeline_stays):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = tmp_path / "copy"
    gone = ["llm", ".*", "__pycache__"] + ([] if pipeline_stays else ["corpus_pipeline.py"])
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == set(queries.RUNS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, con, name):
    assert check.compare(con, queries.RUNS[name](spark, SF), queries.SQL[name]) == ""
