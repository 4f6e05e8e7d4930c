"""Every registered query against its SQL on the small test tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as contract

QUERIES, SQL = contract._audit_queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, sf_small, name):
    assert differences(spark, con, QUERIES[name], SQL[name], sf_small) is None


def test_entry_is_the_scorecard(spark):
    assert contract.entry(spark).columns == ["table_name", "total", "bad", "pct", "score"]
