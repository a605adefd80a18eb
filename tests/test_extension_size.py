"""Expanded sections: nothing that grows with polylines is broadcast, and a log is folded once."""

from stridelake.plans import registry
from stridelake.operators import editing

SF = "/root/testdata/sf0.001"


def test_expanded_sections_broadcast_nothing(spark, monkeypatch):
    """polylines come from a small file, yet no join sends them to the driver."""
    plans, lines = [], editing.polylines
    monkeypatch.setattr(editing, "polylines", lambda *a: plans.append(lines(*a)) or lines(*a))
    plans += [registry.QUERIES["g17_extension_track"](spark, SF), registry.QUERIES["g17_expanded_sections"](spark, SF)]
    text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(text) == 3 and not any("BroadcastHashJoin" in x or "BroadcastExchange" in x for x in text)


def test_small_files_are_dealt_before_they_grow(spark):
    """the points of polylines are made in all tasks, not in the one that reads the file."""
    from stridelake.sources.adapters import Tables

    assert Tables(spark, SF).section_points.rdd.getNumPartitions() >= 4
