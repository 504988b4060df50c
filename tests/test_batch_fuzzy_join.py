"""The pairs of the batch join are not exchanged again after they are made."""

from conftest import DATA, same_as_sql

from reelgrid.plans import catalogue


def test_pairs_are_made_once(spark):
    plan = catalogue.QUERIES["batch_fuzzy_join"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is grouped above the join
    same_as_sql(spark, catalogue.QUERIES["batch_fuzzy_join"], catalogue.SQL["batch_fuzzy_join"])
