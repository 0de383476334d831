"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect
from wardline.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, _, error = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert not error
    if name in ("kaplan_meier", "covered_days", "augment"):
        assert n > 0


def test_entry(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.columns == ["term", "ratio", "std_error"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
