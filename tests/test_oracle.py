"""Every named query runs on the smallest tables and agrees with its SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, oracle_connection):
    frame = QUERIES[name](spark, folder)
    if name in SQL:
        assert oracle.difference(frame, oracle_connection, SQL[name]) is None
    else:
        assert frame.columns
        assert frame.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
