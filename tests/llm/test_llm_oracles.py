import pytest

from palimpsest.llm.queries import oracle_sql, queries
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_spark_and_sql_agree(spark, sf, name):
    assert compare(spark, name, queries()[name], oracle_sql()[name], sf, duck(sf)) == []
