"""Laps are dealt by activity in tasks that follow the input, and ranked in one pass."""

import pytest

from stridelake.plans import registry
from stridelake.sources import adapters

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j5_j6_encounters", "j18_route_of_activity", "w1_w3_indicators"])
def test_tasks_follow_the_bytes_of_the_input(spark, monkeypatch, name):
    """line items are dealt once, by order, over more tasks for larger files."""
    monkeypatch.setattr(adapters, "TASK_BYTES", 10_000)
    assert "hashpartitioning(l_orderkey#" in (plan := plan_of(registry.QUERIES[name](spark, SF))) and ", 12), REPARTITION_BY_NUM" in plan
    assert "hashpartitioning(l_partkey" not in plan


@pytest.mark.parametrize("name", ["i4_record_insights", "i12_i13_scored_candidates", "i14_o6_surface_mix", "i15_consolidated", "g34_stale_records"])
def test_laps_are_ranked_once(spark, monkeypatch, name):
    """One pass over the laps gives relevance, record and candidates; what follows reads one row a section."""
    from stridelake.plans import insights, sections
    from stridelake.plans import detection

    read, make = [], sections.laps
    for plan in (insights, detection):
        monkeypatch.setattr(plan, "laps", lambda t: read.append(1) or make(t))
    df = registry.QUERIES[name](spark, SF)
    assert len(read) == 1 and "discount" not in plan_of(df) and plan_of(df).count("Scan ExistingRDD") >= 1
    assert plan_of(df).count("part.parquet") == 0


def test_timed_laps_are_made_once(spark):
    """what is kept and what is computed anew read the same laps."""
    plan = plan_of(registry.QUERIES["t7_refreshed_indicators"](spark, SF))
    assert "lineitem" not in plan and "l_orderkey" not in plan
