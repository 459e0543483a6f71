import pytest

from memloom.llm import oracles, queries
from tests.core.oracle import assert_same, views

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, sf, name):
    assert_same(queries.queries()[name](spark, sf), views(sf), SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0
