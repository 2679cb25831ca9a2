"""Every registered query against its SQL counterpart on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    out = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(out, con, SQL[name]) == []
    else:
        assert out.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
