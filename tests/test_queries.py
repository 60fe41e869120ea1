"""Every query against its SQL at the smallest scale."""

import pytest
from oracle import SF, check, connect

from matchlib.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        check(spark, con, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
