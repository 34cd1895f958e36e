import pytest

from seqloom.plans.registry import QUERIES, SQL

from .oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


def test_every_query_is_told_apart():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 120
