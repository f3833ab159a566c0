"""The operators' queries against their SQL over a whole small table, and the others' row counts."""

import os

import pytest

from listloom.llm import oracle as sql
from listloom.llm import queries

from oracle import DATA, connection, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert rows_of(queries.queries()[name](spark, DATA)) == rows_of_sql(connection(), sql.oracle_sql()[name])
