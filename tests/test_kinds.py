"""Sections that are alike: links are looked for once for each kind, and every section gets its own."""

import pytest
from pyspark.sql import functions as F

from stridelake.operators import detection, spatial, upkeep

COPIES = 40


@pytest.fixture
def joined(monkeypatch):
    """Rows that each radius join of a test gave."""
    rows, join = [], spatial.radius_join

    def counting(*args):
        out = join(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(spatial, "radius_join", counting)
    return rows


@pytest.fixture
def sections(spark):
    """Copies of a ride and of a run at one place, and of a longer run beside them; section i has kind i % 3."""
    kind = [("Ride", 1000.0, 46.0, 7.0), ("Run", 1000.0, 46.0, 7.0), ("Run", 1900.0, 46.0009, 7.0)]
    return spark.createDataFrame([(i, "auto", *kind[i % 3]) for i in range(3 * COPIES)], "section_id long, section_type string, sport_type string, section_meters double, lat double, lng double")


@pytest.fixture
def points(spark, sections):
    """Polylines of ten points; the third kind's is twice as long and starts 100 m further north."""
    k = F.explode(F.sequence(F.lit(0), (F.col("section_meters") / 100 - 1).cast("int")))
    return sections.select("section_id", "lat", "lng", k.alias("point")).select("section_id", "point", "lat", (F.col("lng") + F.col("point") * 0.0013).alias("lng"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cells_are_not_broadcast(spark, sections):
    """a small file that becomes large by its cells is not sent to the driver."""
    left = sections.select("section_id", "lat", "lng")
    plan = spatial.radius_join(left, left.toDF("other_id", "rlat", "rlng"), 200.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_merge_pairs_of_copies(sections, joined):
    """F1"""
    got = [(a, b) for a, b, _ in rows(spatial.merge_pairs(sections))]
    n = range(3 * COPIES)
    assert got == sorted((a, b) for a in n for b in n if a < b and {a % 3, b % 3} == {0, 1})
    assert max(joined) < 10


def test_merge_components_of_copies(spark, sections, joined):
    """F2"""
    got = rows(spatial.merge_components(sections, spark.createDataFrame([(4, 9), (7, 9), (2, 20)], "section_id long, laps long")))
    assert got == [(i, 4, 2 * COPIES) for i in range(3 * COPIES) if i % 3 < 2]
    assert max(joined) < 10


def test_pruned_copies(spark, sections, points, joined):
    """of each polyline and sport the busiest stays; of equally busy ones the smallest."""
    got = rows(detection.pruned(sections, points, spark.createDataFrame([(4, 9), (7, 9), (2, 20), (3, 1)], "section_id long, laps long"), 50.0, 0.5))
    assert got == [(2, "Run", 20), (3, "Ride", 1), (4, "Run", 9)]
    assert max(joined) < 100


def test_nearby_copies(sections, joined):
    """the nearest are copies at no distance, in order of their ids, and never the section itself."""
    got = {}
    for a, b, metres, rank in rows(spatial.nearby(sections, 150.0, top=5)):
        got.setdefault(a, []).append((rank, b, metres))
    here = [i for i in range(3 * COPIES) if i % 3 < 2]
    far = [i for i in range(3 * COPIES) if i % 3 == 2]
    for i in range(3 * COPIES):
        same = [j for j in (far if i % 3 == 2 else here) if j != i][:5]
        assert sorted(got[i]) == [(k + 1, j, 0.0) for k, j in enumerate(same)]
    assert max(joined) < 10
    few = rows(spatial.nearby(sections.filter("section_id < 4"), 150.0, top=5))
    assert [(a, b, r) for a, b, _, r in few] == [(0, 1, 1), (0, 2, 3), (0, 3, 2), (1, 0, 1), (1, 2, 3), (1, 3, 2), (2, 0, 1), (2, 1, 2), (2, 3, 3), (3, 0, 1), (3, 1, 2), (3, 2, 3)]


def test_overlaps_of_copies(sections, points, joined):
    """F6"""
    got = rows(spatial.overlaps(points, 50.0))
    n = range(3 * COPIES)
    assert got == sorted((a, b, 1.0) for a in n for b in n if a != b and (a % 3 == 2) == (b % 3 == 2))
    assert max(joined) < 100


def test_merge_candidates_of_copies(sections, points, joined):
    """sections of one place and polyline, ten for each."""
    got = {}
    for a, b, metres, fraction, rank in rows(spatial.merge_candidates(sections, points)):
        got.setdefault(a, []).append((rank, b, metres, fraction))
    for i in range(3 * COPIES):
        same = [j for j in range(3 * COPIES) if j != i and (i % 3 == 2) == (j % 3 == 2)][:10]
        assert sorted(got[i]) == [(k + 1, j, 0.0, 1.0) for k, j in enumerate(same)]
    assert max(joined) < 100


@pytest.fixture
def fixes(spark):
    """Two tracks along the polylines of the first two kinds: one there, one back."""
    return spark.createDataFrame([(t, k + 1, 46.0, 7 + (k if t == 1 else 9 - k) * 0.0013) for t in (1, 2) for k in range(10)], "track_id long, seq int, lat double, lng double")


def test_traces_near_copies(fixes, points, joined):
    """F8"""
    got = rows(spatial.traces(fixes, points, 50.0).select("track_id", "line_id", "seq"))
    assert got == [(t, i, k) for t in (1, 2) for i in range(3 * COPIES) if i % 3 < 2 for k in range(1, 11)]
    assert max(joined) < 100


def test_portions_on_copies(fixes, points, joined):
    """F17"""
    got = rows(spatial.portions(fixes, points, 50.0, 1))
    assert got == [(t, i, 1, 1, 10, 10) for t in (1, 2) for i in range(3 * COPIES) if i % 3 < 2]
    assert max(joined) < 100


def test_spans_of_copies(fixes, points, joined):
    """F13, and F16 with other thresholds"""
    for f in (upkeep.spans, upkeep.best_spans):
        got = rows(f(fixes, points, 50.0, 0.8))
        assert got == [(t, i, 1, 10, 1.0, "same" if t == 1 else "reverse") for t in (1, 2) for i in range(3 * COPIES) if i % 3 < 2]
    assert max(joined) < 100


def test_cells_of_a_key_are_not_broadcast(spark, sections):
    """neither where the two sides must agree in a key, as a section and its own track."""
    left = sections.select("section_id", "lat", "lng")
    plan = spatial.radius_join(left, left.withColumnsRenamed({"lat": "rlat", "lng": "rlng"}), 200.0, ["section_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
