"""Every core query with SQL gives the same rows over the smallest data; the others run."""

import pytest
from conftest import DATA, same_as_sql

from reelgrid.plans import catalogue, notation, problems

QUERIES = problems.QUERIES | catalogue.QUERIES | notation.QUERIES
SQL = problems.SQL | catalogue.SQL | notation.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
