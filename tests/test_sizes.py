"""Steps whose intermediate rows must not outgrow the input."""

import numpy as np
from pyspark.sql import functions as F

from stridelake.operators import patterns, routes, smoothing


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_small_groups_are_fitted_as_arrays(spark, monkeypatch):
    """by arrays as by moments of exploded rows; a null y weighs without a value."""
    rng = np.random.RandomState(3)
    data = [(g, float(x), None if x == 7 else float(rng.rand())) for g in range(5) for x in rng.randint(0, 50, 4 + 20 * g)] + [(9, 1.0, 2.0), (9, 1.0, 3.0), (8, None, 1.0), (8, 0.0, 1.0), (8, 5.0, 4.0)]
    df = spark.createDataFrame(data, "g long, x double, y double")
    by_arrays = rows(smoothing.local_linear(df, ["g"], "x", "y", 20))
    monkeypatch.setattr(smoothing, "LISTED", 0)
    by_rows = rows(smoothing.local_linear(df, ["g"], "x", "y", 20))
    assert len(by_arrays) == 6 * 20 and np.allclose(np.array(by_arrays, float), np.array(by_rows, float), atol=1e-7)
    monkeypatch.setattr(smoothing, "LISTED", 40)
    assert np.allclose(np.array(by_arrays, float), np.array(rows(smoothing.local_linear(df, ["g"], "x", "y", 20)), float), atol=1e-7)


def test_medoids_by_blocks(spark, monkeypatch):
    """of kinds in blocks as of all pairs, with tracks of few points, equal tracks and a null."""
    rng = np.random.RandomState(5)
    tracks = {i: [(46 + float(rng.rand()) * 0.01, 7 + float(rng.rand()) * 0.01) for _ in range(3 + 7 * (i % 6))] for i in range(1, 25)}
    tracks[30], tracks[31], tracks[40] = tracks[5], tracks[5], [(46.0, 7.0)] * 9
    data = [(i, k + 1, None if (i, k) == (7, 3) else p[0], p[1]) for i, t in tracks.items() for k, p in enumerate(t)]
    points = spark.createDataFrame(data, "track_id long, seq int, lat double, lng double").cache()
    groups = spark.createDataFrame([(i, i % 2 if i < 40 else 9) for i in tracks], "track_id long, route_id long")
    want = rows(routes.medoid(routes.track_distances(points, groups)))
    assert len(want) == 2
    for block in (1024, 4):
        got = rows(routes.route_medoids(points, groups, block=block))
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=0.0015)


def test_labels_are_made_once(spark):
    """a pattern's figures come from one pass over the clusters."""
    m = spark.createDataFrame([(i, 1, "Ride", 86400 * i, i, 1.0 * i, 2.0 * i) for i in range(40)], "activity_id long, athlete long, sport_type string, date long, moving_time long, distance double, training_load double")
    laps = m.select("activity_id", (F.col("activity_id") % 2).alias("section_id"), F.lit(9.0).alias("lap_time"), "date", F.lit(1).alias("start_index"))
    by = ["athlete", "sport_type"]
    f = patterns.normalised(m, by)
    for df in (patterns.patterns(f, patterns.clusters(f, by), by), patterns.pattern_sections(patterns.clusters(f, by), laps, by)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_copied_sections_share_a_state(spark, monkeypatch):
    """spans are looked for once for each kind of polyline, and every section gets its rows."""
    from stridelake.plans import registry  # noqa: F401, first: it imports the plans in order
    from stridelake.plans import keeping

    class Copies:
        points = spark.createDataFrame([(t, k, k, 46.0, 7 + k * 0.0013) for t in (1, 2, 7) for k in range(10)], "track_id long, point_id long, t long, lat double, lng double")
        section_points = spark.createDataFrame([(s, k, 46.0, 7 + k * 0.0013) for s in range(20) for k in range(10)], "section_id long, point int, lat double, lng double")
        sections = section_points.select("section_id").distinct()

    Copies.spark = spark
    seen, make = [], keeping.section_fixes
    monkeypatch.setattr(keeping, "section_fixes", lambda spans, p: seen.append(spans.count()) or make(spans, p))
    got = rows(keeping.accumulated(Copies))
    assert {r[0] for r in got} == set(range(20)) and len(set(r[1:] for r in got)) * 20 == len(got) and {r[5] for r in got} == {2}
    assert seen == [3]


def test_far_tracks_are_ruled_out(spark, monkeypatch):
    """medoids by bounds are those of all pairs, and few positions are compared point by point; short tracks, copies, nulls, a far route."""
    rng = np.random.RandomState(3)
    data, groups = [], []
    for i in range(260):
        far = 0.2 * (i % 13 == 0) + 0.004 * (i % 7)
        for k in range(3 if i % 41 == 0 else 45 + i % 3):
            lat, lng = 46 + far + float(rng.rand()) * 0.05, 7 + far + float(rng.rand()) * 0.005
            data.append((i, k + 1, None if (i, k) == (5, 0) else lat, float("nan") if (i, k) == (6, 9) else lng))
        groups.append((i, 0 if i < 250 else 1))
    data += [(300, s, lat, lng) for t, s, lat, lng in data if t == 17] + [(301, 1, None, 7.0)]
    groups += [(300, 0), (301, 1), (302, 2)]
    points = spark.createDataFrame(data, "track_id long, seq int, lat double, lng double")
    groups = spark.createDataFrame(groups, "track_id long, route_id long")
    seen, whole = [], routes._summed_distances
    monkeypatch.setattr(routes, "_summed_distances", lambda places, *more: seen.append(places.count()) or whole(places, *more))
    want = rows(routes.route_medoids(points, groups, many=10**9))
    assert len(seen) == 1 and [w[0] for w in want] == [0, 1]
    got = rows(routes.route_medoids(points, groups, block=100, many=2, cells=(0.004, 0.001)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=0.002)
    assert len(seen) == 4 and seen[3] < seen[0] / 4
