import pytest

from webloom.plans.registry import QUERIES, SQL

from .compare import assert_same


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], SQL[name])
