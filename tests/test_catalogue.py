import pytest

from cutloom.plans import catalogue, problems
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_problem_equals_sql(spark, data, name):
    compare(spark, data, problems.QUERIES[name], problems.SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
