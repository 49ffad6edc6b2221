"""Queries that have SQL, against it."""

import pytest
from oracle import connect, differ

from keyloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    assert differ(queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name], connect(FOLDER)) == ""
