"""Training-data queries that SQL can express."""

import pytest
from compare import connection, difference

from veilmark.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    assert difference(spark, connection(small), name, queries.queries()[name], SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0
