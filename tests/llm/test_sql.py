"""The registered queries against DuckDB on the small tables, where SQL can express them."""

import glob
import os

import duckdb
import pytest

from vecscore.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name, tmp_path):
    path = str(tmp_path / "out")
    queries.QUERIES[name](spark, SF).write.parquet(path)
    duck.execute(f"CREATE OR REPLACE TABLE want AS {sql.ORACLE_SQL[name]}")
    columns = [r[0] for r in duck.execute("DESCRIBE want").fetchall()]
    assert sorted(columns) == sorted(spark.read.parquet(path).columns)
    cols = ", ".join(f'"{c}"' for c in columns)
    files = f"'{path}/*.parquet'"
    for a, b in (("want", files), (files, "want")):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchall()[0][0] == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
