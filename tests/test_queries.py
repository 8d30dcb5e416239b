"""Every query with SQL gives the rows of that SQL in DuckDB; the others give rows of a stable schema."""

import glob
import os

import duckdb
import pytest

from rankweave.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(rel.project(", ".join(columns)).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"embedded_ranking_log", "embedded_ranking_nowt", "embedded_ranking_full"}))
def test_rows_only(spark, data, name):
    rows = QUERIES[name](spark, data)
    assert rows.count() > 0 and rows.columns


def test_entry():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
