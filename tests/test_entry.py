import __spark_entry__ as entry
from factloom.plans import catalog


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(catalog.QUERIES) <= set(names) and len(catalog.SQL) > 60


def test_flagship(spark):
    assert entry.entry(spark).columns == ["material", "process", "n_documents", "n_experiments"]
