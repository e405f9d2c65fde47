"""Every query of the core runs on the smallest tables and, where it has SQL, gives the same rows."""

import os

import duckdb
import pandas as pd
import pytest

from mistrail.plans import registry
from tools.compare import plain

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-6)
    else:
        assert len(got.columns)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
