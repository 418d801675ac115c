"""Every query that has SQL, on Spark and on DuckDB over the same tables."""

import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from pixelloom.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    keys = [k for k in ("image_id", "y", "x", "channel", "bin") if k in ours.columns]
    columns = sorted(ours.columns)
    ours, theirs = (d[columns].sort_values(keys).to_numpy(float) for d in (ours, theirs))
    assert ours.shape == theirs.shape and len(ours)
    assert np.allclose(ours, theirs, atol=2e-6, equal_nan=True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert list(got.columns[:1]) == ["image_id"] and got.count() > 0
