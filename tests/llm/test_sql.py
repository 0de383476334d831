"""Queries that have SQL against DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

from wardline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL)[2] == ""
