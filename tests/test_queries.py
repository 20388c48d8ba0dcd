"""Every registered query against its SQL, on the smallest tables."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert differences(QUERIES[name](spark, SF), db, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[0] == "row_key" and rows.count() > 0


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy without ``llm`` still registers all other queries, with or without the pipeline's file."""
    root = Path(contract.__file__).parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "corpus_pipeline.py")
    shutil.copytree(root, tmp_path / "bare", ignore=skip)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for extra in (False, True):
        if extra and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path / "bare")
        said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "bare", capture_output=True, text=True, check=True, timeout=120)
        left = [n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)]
        assert said.stdout.split() == [str(len(left)), str(len([n for n in left if n in ORACLES]))]
