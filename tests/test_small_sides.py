"""Joins with a side that is small by nature keep the large side where it is, whatever the session's broadcast limit."""

import pytest

from __spark_entry__ import queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_sides(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["rec_08_greedy_plan", "rec_09_execution_layers", "rec_10_plan_totals"])
def test_links_come_to_the_candidates(spark, sf, no_small_sides, name):
    """A join by rec_id would put every candidate of a kind into one task."""
    plan = plan_of(queries()[name](spark, sf))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_limits_come_to_the_cells(spark, sf, no_small_sides):
    """A join by column would put every cell of a column into one task."""
    plan = plan_of(queries()["udf_03_expanded_bins"](spark, sf))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
