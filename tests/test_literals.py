import pytest

from . import literals
from .duck import connect, same_rows


@pytest.fixture(scope="module")
def db():
    return connect()


@pytest.mark.parametrize("name", sorted(literals.CATALOGUE.sql))
def test_rows_are_those_written_out(spark, db, name):
    same_rows(spark, db, literals.CATALOGUE.queries[name], literals.CATALOGUE.sql[name])
