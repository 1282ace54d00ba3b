"""Every named query beside its SQL."""

import pytest
from compare import difference

import __spark_entry__ as entry
from tallyloom.plans.all import BOOK

QUERIES = BOOK.queries
SQL = BOOK.oracles


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    assert difference(QUERIES[name], SQL.get(name), spark, data) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
