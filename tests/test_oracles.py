"""Every registered catalogue query gives the rows of its SQL."""

import pytest

from tests.compare import SF, oracle, rows
from tidewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    wanted = oracle(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    once = registry.QUERIES[name](spark, SF).toPandas()
    assert len(once) and rows(once) == rows(registry.QUERIES[name](spark, SF).toPandas())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150


@pytest.mark.parametrize("name", ["j5_prefix_range_join", "j24_interval_join", "j18_two_hop_paths", "j8_resolved_links"])
def test_no_nested_loop_joins(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
