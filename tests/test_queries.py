"""Every registered query with SQL agrees with DuckDB; the rest of the library stands without the training-data subpackage."""

import ast
import os
from datetime import datetime

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names():
    from factorloom.plans import table_queries  # noqa: F401  adds its queries
    from factorloom.plans.queries import SQL

    return sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    from factorloom.plans.queries import QUERIES, SQL

    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    text = lambda f: sorted(tuple("" if pd.isna(v) else f"{float(v):.9g}" if not isinstance(v, str) else v for v in row) for row in f[cols].itertuples(index=False))
    assert text(a) == text(b)


def test_figures_without_losses_and_large_ones(spark, duck):
    """A series without a loss has an infinite Sortino ratio, as in SQL; rounding keeps infinities and what a long can't hold."""
    from factorloom.plans import queries as q

    x = spark.createDataFrame([(float("inf"),), (-1e200,), (1e15 + 0.5,), (2.25,)], "x double").select(q.r(q.c("x"), 5)).collect()
    assert [v[0] for v in x] == [r[0] for r in duck.sql(f"SELECT {q.rounding('round(x, 5)')} FROM (VALUES (0, 'inf'::DOUBLE), (1, -1e200), (2, 1e15 + 0.5), (3, 2.25)) t(i, x) ORDER BY i").fetchall()]


def test_sortino_without_losses(spark, monkeypatch):
    from factorloom.plans import queries as q

    rows = [(s, datetime(2024, i + 1, 1), v) for s, vs in {"up": [0.01, 0.02], "flat": [0.0, 0.0], "down": [-0.01, 0.02]}.items() for i, v in enumerate(vs)]
    monkeypatch.setattr(q, "series", lambda spark, d: spark.createDataFrame(rows, "series string, date timestamp, ret double"))
    got = {r["series"]: r["sortino"] for r in q.performance_metrics(spark, SF).collect()}
    assert got["up"] == float("inf") and got["flat"] is None and got["down"] > 0


def test_nothing_else_imports_the_llm_subpackage():
    for folder, _, files in os.walk(f"{HERE}/factorloom"):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(f"{folder}/{f}").read())):
                    found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("factorloom.llm" in m for m in found), f


def test_the_rest_runs_without_the_llm_folders(tmp_path):
    """A copy without the subpackage, its tests and the pipeline: the entry imports, and its queries and flagship run."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(HERE, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert not [n for n in [*e.queries(), *e.oracle_sql()] if n.startswith("op") or n == "pipeline"]
assert len(e.queries()) > 80 and e.entry(spark).count() == 1
print("ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("ran"), out.stderr[-2000:]


def test_a_missing_library_is_not_taken_for_missing_folders(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def no_xxhash(name, *a, **k):
        if name == "factorloom.llm":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_xxhash)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
