import pytest

from factloom.llm import queries

from ..duck import connect, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    same_rows(spark, connect(), queries.QUERIES[name], queries.SQL[name])
