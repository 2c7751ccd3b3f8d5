"""Every query with SQL against DuckDB on the smallest tables; every other query runs and keeps its schema."""

import pytest
from compare import connection, difference

from veilmark import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, small, name):
    assert difference(spark, con, name, catalog.queries()[name], SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
