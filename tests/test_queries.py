"""Every registered query against its SQL twin at the smallest scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, con):
    assert compare(name, spark, con, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_yields_rows(name, spark):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["target", "n", "percentage"] and df.count() == 3
