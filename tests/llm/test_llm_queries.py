"""Queries with comparison SQL."""

import pytest

from checks.compare import connect, differences
from veil.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder).toPandas(), connect(folder).execute(ORACLE_SQL[name]).df()) == ""
