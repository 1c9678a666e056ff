import pytest

from feedloom.plans import catalogue
from tests.compare import connection, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    columns, rows = rows_of(catalogue.QUERIES[name](spark, FOLDER))
    if name in catalogue.SQL:
        assert (columns, rows) == rows_of_sql(con, catalogue.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
