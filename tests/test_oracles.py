import pytest

from palimpsest.plans import ORACLES, QUERIES
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_spark_and_sql_agree(spark, sf, con, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], sf, con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
