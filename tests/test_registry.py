"""Every registered query against DuckDB on the small tables, as the driver does."""

import glob
import importlib
import os
import sys

import duckdb
import pytest

from vecscore.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name, tmp_path):
    got = registry.QUERIES[name](spark, SF)
    path = str(tmp_path / "out")
    got.write.parquet(path)
    assert spark.read.parquet(path).count() > 0
    if name in registry.ORACLE_SQL:
        duck.execute(f"CREATE OR REPLACE TABLE want AS {registry.ORACLE_SQL[name]}")
        columns = [r[0] for r in duck.execute("DESCRIBE want").fetchall()]
        assert sorted(columns) == sorted(got.columns)
        cols = ", ".join(f'"{c}"' for c in columns)
        files = f"'{path}/*.parquet'"
        for a, b in (("want", files), (files, "want")):
            assert duck.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchall()[0][0] == 0


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20


def test_entry_imports_without_the_subpackage(monkeypatch, tmp_path):
    import shutil
    import subprocess
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "vecscore", tmp_path / "vecscore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES))"], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.strip() == "True", run.stderr[-500:]
