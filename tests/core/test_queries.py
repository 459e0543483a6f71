import pytest

from memloom import catalog, oracles
from tests.core.oracle import assert_same, views

SQL = oracles.oracle_sql()
#: The test tables hold no secrets.
EMPTY = {"redaction_counts", "redaction_counts_save"}


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, sf, con, name):
    assert_same(catalog.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    rows = catalog.queries()[name](spark, sf).collect()
    assert bool(rows) == (name not in EMPTY) and len({str(r) for r in rows}) == len(rows)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(catalog.queries())


def test_doorway_centroids_equal_their_sql_to_the_sign_of_zero(spark, sf, con):
    name = "doorway_centroids"
    want = sorted(map(repr, con.execute(SQL[name]).fetchall()))
    got = sorted(repr((r["key"], r["query_count"], r["centroid"])) for r in catalog.queries()[name](spark, sf).select("key", "query_count", "centroid").collect())
    assert got == want and "-0.0," in "".join(want)
