import pytest

from mistrail.plans import registry
from tests.tables import empty, with_nulls

NAMES = [n for n in registry.queries() if n.startswith("p")]
FOUND = [n for n in NAMES if n.endswith("_found")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, small, tmp_path, name):
    assert registry.queries()[name](spark, empty(small, str(tmp_path))).collect() == []


@pytest.mark.parametrize("name", FOUND)
def test_rows_of_nulls_and_extra_columns_change_nothing(spark, small, tmp_path, name):
    query = registry.queries()[name]
    plain = {tuple(r) for r in query(spark, small).collect()}
    dirty = {tuple(r) for r in query(spark, with_nulls(small, str(tmp_path))).collect()}
    # A ward of nulls lacks both fields like any other.
    assert {r for r in dirty if r[0] is not None} == plain
