import pytest

from factloom.plans import catalog

from .duck import connect, same_rows


@pytest.fixture(scope="module")
def db():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_the_sql(spark, db, name):
    same_rows(spark, db, catalog.QUERIES[name], catalog.SQL[name])
