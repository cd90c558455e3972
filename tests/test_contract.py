"""The driver contract: every query gives rows, and what its SQL gives."""

from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from conftest import ROOT
from millrace.plans import registry
from oracle import SF, connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "source", "clean_text"] and df.count() > 0


def test_queries_without_a_session():
    """Names and SQL can be read before any session exists; SQL is only given for queries."""
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_without_the_corpus_operators(tmp_path):
    """Queries still work where their package and the pipeline have been taken out."""
    code = f"""
import importlib.abc, sys
sys.path.insert(0, {ROOT!r})
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("millrace.llm"):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
