"""Every query of the catalogue against its SQL, at the smallest size."""

import pytest
from oracle import connect, differ

from keyloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert differ(QUERIES[name](spark, FOLDER), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
