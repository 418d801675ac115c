"""Queries with SQL against DuckDB on the test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pixelloom.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, FOLDER).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert list(ours.columns) == list(theirs.columns) and [str(t) for t in ours.dtypes] == [str(t) for t in theirs.dtypes]
    assert sorted(map(tuple, ours.to_numpy().tolist())) == sorted(map(tuple, theirs.to_numpy().tolist()))
