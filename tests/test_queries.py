"""Every core query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest

from oracle import DATA, assert_same, connect

from sidforge.plans import activity, catalogue

CORE = activity.QUERIES | catalogue.QUERIES
SQL = activity.ORACLES | catalogue.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(CORE[name](spark, DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert CORE[name](spark, DATA).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "codes"] and df.count() > 0
    assert set(CORE) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
