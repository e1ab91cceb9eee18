"""Every registered query with SQL against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shown(df.collect(), df.columns) == shown(want.fetchall(), want.columns)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_works_without_the_training_part(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    leave = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("symlens", "tests"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=leave)
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    some = ["tests/test_churn_and_diff.py"]  # the whole suite takes too long to run within itself
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", *some], cwd=tmp_path, check=True, env=env)
