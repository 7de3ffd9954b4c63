"""Every registered query on the smallest tables: against its SQL where it has one, else it must run."""

import pytest
from check_oracle import connect, difference
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_only_for_registered():
    assert set(SQL) <= set(QUERIES)
