"""Expected values of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators import fitness, graph, heatmap, insights, patterns, sections, spatial, strength
from stridelake.sources import tables
from stridelake.streaming import recording


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_rounding_and_days(spark):
    assert one(spark, S.round_half_up(F.lit(-2.5))) == -2 and one(spark, F.round(F.lit(-2.5))) == -3
    assert one(spark, S.calendar_days_between(F.lit(86399), F.lit(86400))) == 1
    assert one(spark, S.calendar_days_between(F.lit(86400), F.lit(0))) == 0
    assert one(spark, S.elapsed_days(F.lit(86399), F.lit(86400))) == 0
    d = S.epoch_date(F.lit(1704067200))
    assert one(spark, F.weekday(d)) == 0 and one(spark, S.season(d)) == "winter"


def test_names_and_classes(spark):
    assert [one(spark, S.exercise_name(F.lit(c))) for c in (0, 32, 33, 65535)] == ["Bench Press", "Run", "Exercise 33", "Unknown Exercise"]
    assert [one(spark, S.form_zone(F.lit(float(t)))) for t in (-31, -30, -10, 5, 25)] == ["highRisk", "optimal", "greyZone", "fresh", "transition"]
    assert one(spark, S.sport_category(F.lit("TrailRun"))) == "running" and one(spark, S.max_plausible_speed(F.lit("Hike"))) == 8.0
    assert one(spark, S.auto_named(F.lit("Ride Section 12"))) and not one(spark, S.auto_named(F.lit("My climb")))
    assert one(spark, S.punitive(F.lit("You missed a day"))) and not one(spark, S.punitive(F.lit("A good week")))
    assert one(spark, S.xml_escape(F.lit("a<&\"'>"))) == "a&lt;&amp;&quot;&apos;&gt;"


def test_arrays(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, S.upper_middle(a(4, 1, 3, 2))) == 3
    assert one(spark, S.elevation_gain(a(1.0, 3.0, 2.0, 5.0))) == 5.0
    assert one(spark, S.nearest_on_curve(a(1, 5, 9), a(10, 20, 30), F.lit(7))) == 20
    assert one(spark, S.lap_seconds(a(0, 10, 25), F.lit(0), F.lit(2))) == 25 and one(spark, S.lap_seconds(a(0), F.lit(0), F.lit(3))) is None


def lap_frame(spark, rows):
    return spark.createDataFrame(rows, "section_id long, direction string, activity_id long, start_index int, date long, time double")


def test_indicator_records_and_trends(spark):
    rows = [(1, "same", i, 0, i * 100, t) for i, t in enumerate([100.0, 90.0, 89.99995, 110.0])] + [(2, "same", 9, 0, 5, 50.0)]
    got = {(r["activity_id"], r["kind"]): r["value"] for r in sections.indicators(lap_frame(spark, rows)).collect()}
    assert got == {(1, "section_pr"): 1, (1, "section_trend"): 1, (2, "section_pr"): 1, (2, "section_trend"): 1, (3, "section_trend"): -1}


def test_completeness(spark):
    df = spark.createDataFrame([("same", 100.0, 70.0), ("same", 100.0, 69.0), ("partial", None, 100.0), ("reverse", None, 1.0), ("same", 0.0, 1.0)], "direction string, section_meters double, distance_meters double")
    assert [r["ok"] for r in df.select(sections.complete().alias("ok")).collect()] == [True, False, False, True, True]


def test_zones_and_empty_periods(spark):
    m = spark.createDataFrame([(1, "Ride", 100, 3600, 10.0, 5.0)], "activity_id long, sport_type string, date long, moving_time long, distance double, training_load double")
    assert tuple(fitness.period_stats(m, 0, 50).first()) == (0, 0, 0.0, 0.0)
    assert fitness.zone_distribution(m, "Ride", "cadence").count() == 0
    assert fitness.zone_distribution(m, "Ride", "hr").count() == 5


def test_hrv_needs_five(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}", float(v)) for i, v in enumerate([50, 50, 50, 60, 60, 60], 1)], "date string, hrv double")
    assert fitness.hrv_trend(df, 28).first()["trend"] == "improving"
    assert fitness.hrv_trend(df.limit(4), 28).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(values(graph.connected_components(e)))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_radius_join_is_whole(spark):
    rng = np.random.RandomState(3)
    p = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(46 + rng.rand(300) / 50, 7 + rng.rand(300) / 50))]
    df = spark.createDataFrame(p, "id long, lat double, lng double")
    got = {(a, b) for a, b in values(spatial.radius_join(df, df.toDF("other", "rlat", "rlng"), 150.0).select("id", "other"))}
    assert got == {(a[0], b[0]) for a in p for b in p if recording.distance(a[1], a[2], b[1], b[2]) <= 150.0}


@pytest.mark.parametrize("lat, lng, spread", [(80.0, 10.0, 0.01), (89.995, 0.0, 0.005), (0.0, 180.0, 0.002), (-75.0, -179.999, 0.005), (60.0, 179.9995, 0.002), (-89.999, 90.0, 0.001)])
def test_radius_join_anywhere(spark, lat, lng, spread):
    """Near the poles, and over the antimeridian, where longitudes jump."""
    rng = np.random.RandomState(4)
    turn = 360 if abs(lat) > 89 else spread * 2 / max(math.cos(math.radians(lat)), 0.01)
    p = [(i, max(-90.0, min(90.0, lat + float(a) * spread)), (lng + float(b) * turn + 180) % 360 - 180) for i, (a, b) in enumerate(rng.rand(200, 2) - 0.5)]
    p += [(900, lat, lng), (901, lat, lng + 0.0001), (902, lat, -lng), (903, None, lng), (904, lat, None)]
    df = spark.createDataFrame(p, "id long, lat double, lng double")
    got = sorted(values(spatial.radius_join(df, df.toDF("other", "rlat", "rlng"), 200.0).select("id", "other")))
    full = [x for x in p if None not in x]
    assert got == sorted((a[0], b[0]) for a in full for b in full if recording.distance(a[1], a[2], b[1], b[2]) <= 200.0)
    assert len(got) > len(full)


def test_boxes_near_a_box_at_any_latitude(spark):
    rows = [(1, 70.0, 25.004), (2, 70.0, 25.02), (3, 70.0, -334.996), (4, 10.0, 25.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    near = spatial.near_box(69.9, 70.1, 24.9, 25.0, 180.0, (F.col("lat"), F.col("lat")), (F.col("lng"), F.col("lng")))
    assert sorted(r["id"] for r in df.filter(near).collect()) == [1, 3]


def test_line_sweep_touches_every_tile(spark):
    """A long line at zoom 14, against tiles of points set closely along it; a missing fix breaks the line."""
    zooms = [6, 11, 14]
    a, b = (46.0, 7.0), (46.4, 9.0)
    df = spark.createDataFrame([(1, 1, *a), (1, 2, *b), (1, 3, None, None), (1, 4, 40.0, 0.0), (2, 1, 50.0, 1.0)], "track_id long, seq int, lat double, lng double")
    got = {tuple(r) for r in heatmap.line_tiles(df, zooms).select("track_id", "z", "x", "y").collect()}

    def world(lat, lng, z):
        r = math.radians(lat)
        return (lng + 180) / 360 * 2**z, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * 2**z

    for z in zooms:
        (x0, y0), (x1, y1) = world(*a, z), world(*b, z)
        want = {(1, z, int(x0 + (x1 - x0) * k / 50_000), int(y0 + (y1 - y0) * k / 50_000)) for k in range(50_001)}
        want |= {(1, z, *map(int, world(40.0, 0.0, z))), (2, z, *map(int, world(50.0, 1.0, z)))}
        assert {g for g in got if g[1] == z} == want
    assert sum(g[1] == 14 for g in got) > 92
    plan = heatmap.tile_plan(df, zooms, halo=False)
    assert plan.count() == len(got) and heatmap.tile_plan(df, zooms, halo=False, existing=plan.limit(10)).count() == len(got) - 10


def test_strokes_are_whole_and_smooth(spark):
    """Pixels of strokes of any length, by distance from the line; long ones are not thinned, joints have two round ends."""
    zoom = 10
    pts = [(1, 1, 46.0, 7.0), (1, 2, 46.01, 7.9), (1, 3, 46.01, 7.9), (1, 4, 46.2, 7.9)]
    got = {(r["x"] * 512 + r["col"], r["y"] * 512 + r["row"]): r["intensity"] for r in heatmap.pixel_intensity(spark.createDataFrame(pts, "track_id long, seq int, lat double, lng double"), [zoom]).collect()}
    radius, intensity, scale = 2.0, 16.0, 512 * 2**zoom
    xy = [((g + 180) / 360 * scale, (1 - math.log(math.tan(math.radians(a)) + 1 / math.cos(math.radians(a))) / math.pi) / 2 * scale) for _, _, a, g in pts]
    want = {}
    for (ax, ay), (bx, by) in zip(xy, xy[1:]):
        gx, gy = np.meshgrid(np.arange(int(min(ax, bx)) - 5, int(max(ax, bx)) + 6), np.arange(int(min(ay, by)) - 5, int(max(ay, by)) + 6), indexing="ij")
        ll = (bx - ax) ** 2 + (by - ay) ** 2
        at = np.clip(((gx + 0.5 - ax) * (bx - ax) + (gy + 0.5 - ay) * (by - ay)) / ll, 0, 1) if ll > 1e-4 else 0.0
        e = np.clip(np.hypot(gx + 0.5 - ax - at * (bx - ax), gy + 0.5 - ay - at * (by - ay)) - radius, 0, 1)
        v = np.floor(intensity * (1 - e * e * (3 - 2 * e)) + 0.5).astype(int)
        for x, y, n in zip(gx[v > 0].tolist(), gy[v > 0].tolist(), v[v > 0].tolist()):
            want[(x, y)] = want.get((x, y), 0) + n
    assert got == want


def test_stale_tiles_of_a_large_box(spark):
    plan = spark.createDataFrame([(17, 68000 + i, 46000, 1) for i in range(0, 3000, 100)] + [(3, 4, 2, 1), (3, 7, 7, 1)], "z int, x long, y long, tracks long")
    box = spark.createDataFrame([(40.0, 50.0, 7.0, 12.0), (46.0, 46.1, 9.0, 9.1)], "min_lat double, max_lat double, min_lng double, max_lng double")
    got = sorted(tuple(r) for r in heatmap.stale_tiles(plan, box, [3, 17]).collect())
    n = 2**17
    assert got == sorted([(3, 4, 2, 1)] + [(17, x, 46000, 1) for x in range(68000, 71000, 100) if int(187 / 360 * n) <= x <= int(192 / 360 * n)])


def test_overlap_and_pruning(spark):
    """Sections of which one lies on the other, by half, or far off."""
    from stridelake.operators import detection

    line = lambda s, lat, k0, k1: [(s, k, lat, 7 + k * 0.001) for k in range(k0, k1)]
    pts = spark.createDataFrame(line(1, 46.0, 0, 10) + line(2, 46.0001, 0, 10) + line(3, 46.0002, 5, 15) + line(4, 46.5, 0, 10), "section_id long, point int, lat double, lng double")
    over = {(r["section_id"], r["other_id"]): r["fraction"] for r in spatial.overlaps(pts, 50.0).collect()}
    assert over == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.5, (3, 1): 0.5, (2, 3): 0.5, (3, 2): 0.5}
    s = spark.createDataFrame([(i, "auto", "Run", 1000.0, 46.0, 7.0 + i / 10000) for i in (1, 2, 3, 4)], "section_id long, section_type string, sport_type string, section_meters double, lat double, lng double")
    laps = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "section_id long, laps long")
    assert sorted(r["section_id"] for r in detection.pruned(s, pts, laps, 50.0, 0.6).collect()) == [2, 3, 4]
    got = [(r["section_id"], r["other_id"], r["rank"]) for r in spatial.merge_candidates(s, pts, top=1).collect()]
    assert sorted(got) == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_medoid_by_sampled_points(spark):
    from stridelake.operators import routes

    rng = np.random.RandomState(5)
    tracks = {i: [(46 + k * 0.001 + float(rng.rand()) * 0.0005 * i, 7 + float(rng.rand()) * 0.0005 * i) for k in range(10 + 11 * i)] for i in range(1, 6)}
    pts = spark.createDataFrame([(i, k + 1, *p) for i, t in tracks.items() for k, p in enumerate(t)], "track_id long, seq int, lat double, lng double")
    groups = spark.createDataFrame([(i, 7) for i in tracks], "track_id long, route_id long")

    def gap(a, b):
        k = min(20, len(a), len(b))
        x, y = ([t[i * (len(t) // k)] for i in range(k)] for t in (a, b))
        return sum(min(recording.distance(*p, *q) for q in y) for p in x) / k

    d = {(r["a"], r["b"]): r["d"] for r in routes.track_distances(pts, groups).collect()}
    assert set(d) == {(i, j) for i in tracks for j in tracks if i != j} and all(abs(d[i, j] - gap(tracks[i], tracks[j])) < 1e-6 for i, j in d)
    total = {i: sum(d[i, j] for j in tracks if j != i) for i in tracks}
    assert routes.medoid(routes.track_distances(pts, groups)).first()["medoid"] == min(total, key=total.get)


def test_folds_carry_over_batches(spark):
    """A track over many Arrow batches, against the fold in one go."""
    rng = np.random.RandomState(6)
    rows = [(k, t, 46 + float(rng.rand()) * 0.001, 7.0, "Ride", t) for k in (1, 2, 3) for t in range(0, 400, 1 + k)]
    df = spark.createDataFrame(rows, "track_id long, t long, lat double, lng double, sport_type string, point_id long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in recording.cleaned_batch(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [(k, *r) for k in (1, 2, 3) for r in recording.clean([(t, a, g, 35.0) for i, t, a, g, *_ in rows if i == k], None)[0]]
    assert got == sorted(want)


def test_pattern_sections_by_rank(spark):
    rows = [(a, 1, float(100 - a), a, 0) for a in range(8)] + [(0, 2, 50.0, 0, 0)]
    laps = spark.createDataFrame(rows, "activity_id long, section_id long, lap_time double, date long, start_index int")
    labels = spark.createDataFrame([(a, 5, 0) for a in range(8)], "activity_id long, athlete long, cluster int")
    got = [tuple(r) for r in patterns.pattern_sections(labels, laps, ["athlete"]).select("section_id", "appearances", "best", "median_recent", "trend").collect()]
    assert got == [(1, 8, 93.0, 95.0, 1)]


def test_k_means_separates():
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.normal(c, 0.02, (20, 4)) for c in (0.1, 0.9)])
    label, s = patterns.cluster_group(x)
    assert len(set(label[:20])) == 1 and len(set(label)) == 2 and s.min() > 0.8
    assert patterns.cluster_group(x[:11]) is None
    assert patterns.cluster_group(np.full((20, 4), 0.5)) is None


def test_scores_and_mix(spark):
    rows = [(str(i), "section_pr", 1, 0.5, "t", 1, 5, 1.0, 3, True) for i in range(6)] + [(f"h{i}", "hrv_trend", 2, 1.0, "t", 1, 5, 0.1, 0, False) for i in range(4)]
    c = insights.scored(insights.gates(spark.createDataFrame(rows, insights.COLUMNS)))
    assert {r["category"]: r["score"] for r in c.collect()} == {"section_pr": 250 + 15 + 15 + 10 + 5 + 10, "hrv_trend": 200 + 30 + 8 - 5}
    assert [r["category"] for r in insights.mixed(c).collect()].count("section_pr") == 3 and insights.mixed(c).count() == 5


def test_strength_weights(spark):
    sets = spark.createDataFrame([(1, 0, 10, 60.0, "Bench Press", 5), (1, 0, None, 60.0, "Bench Press", 5)], "activity_id long, exercise_category int, repetitions int, weight_kg double, exercise string, date long")
    got = {r["muscle"]: (r["weighted_sets"], r["reps"], r["volume"]) for r in strength.muscle_summary(sets).collect()}
    assert got == {"chest": (2.0, 10, 660.0), "triceps": (2.0, 10, 660.0), "deltoids": (1.0, 0, 0.0)}


def test_png_is_an_image():
    data = heatmap.png(heatmap.colours(np.zeros((4, 4))))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == b"\x00\x00\x00\x04\x00\x00\x00\x04"
    g = np.zeros((5, 5))
    g[2, 2] = 16
    assert heatmap.blur(g)[2, 2] == 4 and math.isclose(heatmap.blur(g).sum(), 16)


def test_codecs(spark):
    df = spark.createDataFrame([([46.1234567, -7.0, 0.0],), (None,), ([],)], "v array<double>")
    back = [r["b"] for r in df.select(tables.decode_coordinates(tables.encode_coordinates("v")).alias("b")).collect()]
    assert back == [pytest.approx([46.1234567, -7.0, 0.0]), None, []]
    p = one(spark, tables.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(r["lat"], r["lng"]) for r in p] == [pytest.approx(x) for x in [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]]
    lat, lng = F.array(*map(F.lit, [0.0, 0.0, 0.0])), F.array(*map(F.lit, [0.0, 0.5, 1.0]))
    assert one(spark, tables.simplified(lat, lng, F.lit(10.0))) == [0, 2]


def test_json_parsing(spark):
    j = '[{"type":"latlng","data":[1,2,3],"data2":[4,5]},{"type":"altitude","data":[9]},{"type":"fixed_altitude","data":[8]}]'
    s = one(spark, tables.parse_streams(F.lit(j)))
    assert len(s["track"]) == 2 and s["altitude"] == [8.0]
    c = one(spark, tables.parse_pace_curve(F.lit('{"list":[{"distance":[100,200],"values":[20,0],"paceModels":[{"type":"X"},{"type":"CS","criticalSpeed":4.5}]}]}')))
    assert c["speed"] == [5.0, 0.0] and c["critical_speed"] == 4.5
    assert one(spark, tables.slices(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [0, 1, 3])))) == [[1], [2, 3]]
    assert one(spark, tables.slices(F.array(F.lit(1)), F.array(*map(F.lit, [0, 9])))) is None


def test_upsert_takes_the_new_row(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, d long, v string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 1, "d"), (3, 2, "e")], "k long, d long, v string")
    assert values(tables.upsert(old, new, ["k"], ["d"])) == [(1, 5, "a"), (2, 1, "c"), (3, 2, "e")]


FIXES = [(1, 10, 46.0, 7.0), (1, 10, 46.0, 7.1), (1, 11, 46.0001, 7.0), (1, 12, 47.0, 7.0), (1, 13, 46.0002, 7.0), (1, 5, 46.0, 7.0)]


def test_cleaning_drops_late_fixes_and_jumps(spark):
    df = spark.createDataFrame([(*f, "Ride", i) for i, f in enumerate(FIXES)], "track_id long, t long, lat double, lng double, sport_type string, point_id long")
    assert [r["t"] for r in recording.cleaned_batch(df).orderBy("t").collect()] == [10, 11, 13]


def test_cleaning_as_a_stream(spark, tmp_path):
    schema = "track_id long, t long, lat double, lng double, sport_type string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate((FIXES[:3], FIXES[3:])):
        spark.createDataFrame([(*f, "Ride") for f in part], schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    q = recording.cleaned_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["t"] for r in spark.read.parquet(out).orderBy("t").collect()]
    assert got in ([10, 11, 13], [5, 10, 11, 13])


def test_auto_pause(spark):
    rows = [(1, t, t, v) for t, v in enumerate([5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.1, 2.6, 3.0])]
    df = spark.createDataFrame(rows, "track_id long, t long, point_id long, v double")
    assert values(recording.auto_pause(df, "v", 2.0, 5)) == [(1, 6, "pause"), (1, 8, "resume")]


def test_engine_surface(spark, tmp_path):
    import os

    from stridelake.api import Engine
    from stridelake.sources.adapters import Tables

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    e = Engine(Tables(spark, sf))
    frames = [
        e.fitness.period_stats(0, 10**10), e.fitness.zone_distribution("Ride", "power"), e.sections.summaries(), e.sections.performances(5), e.sections.calendar(5), e.sections.ranked(978307200, 3),
        e.routes.groups(), e.routes.performances(7), e.activities.in_viewport(46, 47, 7, 8), e.strength.balance(0, 10**10), e.maps.tile_plan([10]),
    ]
    assert all(f.columns and f.count() >= 0 for f in frames)
    points = e.maps.tracks
    assert e.detection.groups(points).count() == points.select("track_id").distinct().count()
    assert e.detection.flow_sections(e.detection.turns(points)).columns and e.sections.merge_pairs().columns != e.sections.merge_candidates().columns
    heatmap.write_tiles(e.maps.tiles(8), str(tmp_path))
    assert list(tmp_path.glob("8/*/*.png"))


def test_store_and_versions(spark, tmp_path):
    import os

    from stridelake.plans import registry
    from stridelake.sources import store
    from stridelake.sources.adapters import Tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables are absent")
    t = Tables(spark, "/root/testdata/sf0.001")
    stored = store.store(t, str(tmp_path / "store"))
    for name in ("a8_a9_section_summaries", "p13_excluded_ids"):
        assert values(registry.OVER_TABLES[name](stored)) == values(registry.OVER_TABLES[name](t))
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    path = str(tmp_path / "derived")
    assert store.materialised(spark, path, 1, lambda: build(3)).count() == 3
    assert store.materialised(spark, path, 1, lambda: build(4)).count() == 3
    assert store.materialised(spark, path, 2, lambda: build(5)).count() == 5 and built == [3, 5]


def test_scalar_look_ups(spark):
    z, x, y = F.lit(10), F.lit(532), F.lit(360)
    a, b, c, d = (one(spark, v) for v in S.tile_bounds(z, x, y))
    assert a < b and c < d and one(spark, S.tile_x(F.lit((c + d) / 2), 10)) == 532 and one(spark, S.tile_y(F.lit((a + b) / 2), 10)) == 360
    assert one(spark, S.tile_count(F.lit(a + 1e-6), F.lit(b - 1e-6), F.lit(c + 1e-6), F.lit(d - 1e-6), 9, 11)) == 1 + 1 + 4
    assert [S.smoothing_window(*p) for p in (("auto", "6m"), ("none", "1y"), (7, "7d"))] == [14, 0, 7]


def test_patterns_from_labels(spark):
    """The gates and figures of patterns, and the pattern of a day, against plain loops over given labels."""
    from collections import Counter
    from datetime import datetime, timezone

    rng = np.random.RandomState(7)
    rows, labels = [], []
    for i in range(240):
        athlete, cluster = i % 3, i // 3 % 3
        rows.append((athlete, "Ride", i, int(978307200 + 86400 * (rng.randint(0, 20 if cluster == 2 else 400))), int(rng.randint(1000, 5000)), float(rng.randint(1, 90)), float(rng.randint(1, 50))))
        labels.append((i, cluster, float([0.6, 0.35, 0.5][cluster] if athlete else 0.2)))
    m = spark.createDataFrame(rows, "athlete long, sport_type string, activity_id long, date long, moving_time long, distance double, training_load double")
    lab = spark.createDataFrame(labels, "activity_id long, cluster int, silhouette double")
    by = ["athlete", "sport_type"]
    got = {(r["athlete"], r["cluster"]): r for r in patterns.patterns(patterns.normalised(m, by), lab, by).collect()}

    season = lambda d: "winter spring summer autumn".split()[datetime.fromtimestamp(d, timezone.utc).month % 12 // 3]
    want = {}
    for athlete in range(3):
        for cluster in range(3):
            own = [r for r in rows if r[0] == athlete and labels[r[2]][1] == cluster]
            sil = np.mean([labels[r[2]][2] for r in own])
            span = (max(r[3] for r in own) - min(r[3] for r in own)) // 86400
            month = len(own) / (max(span, 1) / 30.44)
            if len(own) >= 6 and span >= 90 and sil >= 0.3 - 1e-12 and month >= 0.3:
                s = Counter(season(r[3]) for r in own)
                top = max(s.items(), key=lambda x: (x[1], x[0]))
                day = max(Counter(datetime.fromtimestamp(r[3], timezone.utc).weekday() for r in own).items(), key=lambda x: (x[1], x[0]))
                conf = 0.3 * min(len(own) / 20, 1) + 0.3 * sil + 0.2 * min(month / 4, 1) + 0.2 * day[1] / len(own)
                want[athlete, cluster] = (len(own), span, top[0] if top[1] > 0.6 * len(own) or len(s) < 3 else "all", day[0], round(conf, 5))
    assert {k: (r["members"], r["span_days"], r["season"], r["primary_day"], round(r["confidence"], 5)) for k, r in got.items()} == want and len(want) == 4
    today = patterns.pattern_today(spark.createDataFrame(list(got.values())), by, 0, "summer").collect()
    near = lambda r: min(abs(r["primary_day"] - 0), 7 - abs(r["primary_day"] - 0)) <= 1 and r["season"] in ("summer", "all")
    best = {}
    for k, r in got.items():
        if near(r) and (k[0] not in best or (-r["confidence"], r["cluster"]) < (-best[k[0]]["confidence"], best[k[0]]["cluster"])):
            best[k[0]] = r
    assert {r["athlete"]: r["cluster"] for r in today} == {k: r["cluster"] for k, r in best.items()}
