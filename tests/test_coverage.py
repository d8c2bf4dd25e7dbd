from factloom.plans import coverage

from .duck import connect, same_rows

MORE = "/root/testdata/sf0.01"


def test_gaps_are_those_of_all_processes(spark):
    """A hundred processes, of which the forty most mentioned do not hold the greatest gaps."""
    every = coverage.CATALOGUE.sql["find_gaps_all"] + " ORDER BY n_documents, n_experiments, material, process LIMIT 50"
    same_rows(spark, connect(MORE), coverage.CATALOGUE.queries["find_gaps"], every, MORE)
