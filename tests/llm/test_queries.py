"""The queries on language-model data run on the smallest tables and, where they have SQL, give the same rows."""

import os

import duckdb
import pandas as pd
import pytest

from mistrail.llm.queries import QUERIES, SQL
from tools.compare import plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
        want = con.execute(SQL[name]).df()
        pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-6)
    else:
        assert len(got.columns)
