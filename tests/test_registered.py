"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry

from catalogue import ORACLES, QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, folder, connection, name):
    found = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found.count() >= 0
    else:
        assert difference(found, connection, sql) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1
    assert rows[0]["count_actual"] > 0
