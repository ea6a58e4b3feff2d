"""Every registered query of the library against its SQL in DuckDB."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from rankflow import queries as q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = q.queries()[name](spark, DIR)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    result = db.execute(q.oracle_sql()[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


def test_the_rest_stands_alone():
    """Nothing outside the training-data folder imports it, but for the guarded entry."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{here}/rankflow/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert ".llm" not in (text := open(f).read()) and "import llm" not in text, f


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_are_read_without_a_session():
    """Names and SQL are asked for before there is a session; so is every module imported."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import importlib, pkgutil
import __spark_entry__ as e, rankflow
assert set(e.oracle_sql()) <= set(e.queries())
for m in pkgutil.walk_packages(rankflow.__path__, "rankflow."):
    importlib.import_module(m.name)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
print(*e.queries())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline", "pair_gradients"} <= {x.split("_")[0] if x.startswith("op") else x for x in run.stdout.split()}
