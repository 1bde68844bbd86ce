"""Queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from chainloom.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) == ""
