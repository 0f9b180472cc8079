"""Every registered query against its SQL in another engine."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, differences
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    f, sql = QUERIES[name]
    rows = f(spark, sf).toPandas()
    assert len(rows)
    if sql:
        assert differences(rows, con.execute(sql).df()) == ""


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql())
