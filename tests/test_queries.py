"""Every registered query against its SQL on the small tables."""

import pytest
from oracle_check import difference, open_tables

from __spark_entry__ import entry, oracle_sql, queries
from postsieve.plans.oracle import ORACLE
from postsieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    actual = queries()[name](spark, SF).toPandas()
    assert difference(actual, con.execute(oracle_sql()[name]).df()) is None
