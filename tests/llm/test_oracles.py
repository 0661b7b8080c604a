import pytest

from textassay.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, same, name):
    same(QUERIES[name](spark, small), ORACLE_SQL[name])
