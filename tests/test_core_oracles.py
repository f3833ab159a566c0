"""Every query of the catalogue against its oracle, and a schema check of those without one."""

import os

import pytest

from listloom import catalogue

from oracle import DATA, connection, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, con, name):
    assert rows_of(catalogue.queries()[name](spark, DATA)) == rows_of_sql(con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
