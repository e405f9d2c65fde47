import pytest

from mistrail.llm.queries import QUERIES
from tests.tables import empty, with_nulls


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "p7_fill"])
def test_empty_tables_give_no_rows(spark, small, tmp_path, name):
    assert QUERIES[name](spark, empty(small, str(tmp_path))).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_found")])
def test_rows_of_nulls_and_extra_columns_change_nothing(spark, small, tmp_path, name):
    plain = {tuple(r) for r in QUERIES[name](spark, small).collect()}
    dirty = {tuple(r) for r in QUERIES[name](spark, with_nulls(small, str(tmp_path))).collect()}
    assert {r for r in dirty if None not in r} == plain
