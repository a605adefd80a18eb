"""Steps whose work must follow the input: blocks, kinds and rounds."""

import math

import numpy as np

from stridelake.operators import heatmap, keeping, patterns, routes
from stridelake.operators.detection import DetectionConfig
from stridelake.operators.routes import EARTH_M
from stridelake.sources.folders import shared_folder
from stridelake.streaming.indexing import POINTS, TrackIndex


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_match(a, b, perfect, zero):
    def gap(p, q):
        la, ga, lb, gb = map(math.radians, (*p, *q))
        return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((gb - ga) / 2) ** 2)))

    way = lambda x, y: sum(min([zero] + [gap(p, q) for q in y if None not in p and None not in q]) for p in x) / len(x)
    amd = (way(a, b) + way(b, a)) / 2
    return amd, max(min((zero - amd) / (zero - perfect) * 100, 100), 0)


def test_match_percent_by_blocks(spark):
    """members against their route's track, in blocks; tracks of any length and latitude, one far away, a null; a route's track is sent by parts."""
    rng = np.random.RandomState(8)
    tracks = {i: [(46 + float(rng.rand()) * 0.02, 7 + float(rng.rand()) * 0.02) for _ in range(4 + 9 * i)] for i in range(12)}
    tracks[20], tracks[21] = [(85.0, 7.0), (85.0, 8.0)], [(85.0, 7.02), (85.001, 7.9), (20.0, 0.0)]
    tracks[22], tracks[23] = [(46.0, 7.0), (None, 7.0)], [(-46.0, 7.0)] * 9
    data = [(i, k + 1, *p) for i, t in tracks.items() for k, p in enumerate(t)]
    points = spark.createDataFrame(data, "track_id long, seq int, lat double, lng double")
    pairs = [(i, 0) for i in range(1, 12)] + [(21, 20), (22, 0), (23, 0)]
    members = spark.createDataFrame(pairs, "track_id long, route long")
    want = [(a, *plain_match(tracks[a], tracks[b], 10.0, 500.0)) for a, b in pairs]
    for block, together in ((128, 1024), (7, 3)):
        got = rows(routes.match_percent(points, members, 10.0, 500.0, block, together))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(np.array(got), np.array(want), atol=0.0011)


def test_index_stores_kinds_of_sections(spark):
    """sections of equal polyline, sport and length share stored rows; all tables read as without sharing."""
    of = [(1, "Ride", 900.0), (2, "Ride", 900.0), (3, "Run", 900.0), (4, "Ride", None), (5, "Ride", 9000.0), (6, "Ride", 900.0)]
    sections = spark.createDataFrame(of, "section_id long, sport_type string, section_meters double")
    lines = [(s, p, 46.0 + p * 0.0009, 7.0) for s in range(1, 7) for p in range(3, 12 if s < 6 else 11)]
    fixes = [(i, "Run" if i == 3 else "Ride", k + 1, 10**9 + i * 10_000 + k * (10 + i), 46.0 + k * 0.0009, 7.0) for i in range(1, 5) for k in range(20)]
    batch = spark.createDataFrame(fixes, POINTS)
    read = []
    for shift in (0, 1000):  # other numbers of points make other polylines
        polylines = spark.createDataFrame([(s, p + shift * s, lat, lng) for s, p, lat, lng in lines], "section_id long, point int, lat double, lng double")
        index = TrackIndex(spark, shared_folder(spark, "test-kinds"), sections, polylines, DetectionConfig())
        index.index(batch)
        read.append([rows(index.traversals.read().drop("lap_pace")), rows(index.indicators.read().select("section_id", "activity_id", "kind", "value", "lap_time"))])
        assert {r["section_id"] for r in index.traversals.stored().collect()} == ({1, 3, 4, 5, 6} if not shift else {1, 2, 3, 4, 5, 6})
    assert read[0] == read[1] and len(read[0][0]) == 3 * 5 + 1 and read[0][1]


def test_tiles_are_told_apart_without_a_shuffle(spark):
    """a track's tiles at all zooms come from the task that holds it; repeats and nulls make no row more."""
    rng = np.random.RandomState(2)
    data = [(i, k + 1, None if (i, k) == (3, 4) else 46 + float(rng.rand()) * 0.1, float("nan") if (i, k) == (4, 2) else 7 + float(rng.rand()) * 0.1) for i in range(6) for k in range(1 + 5 * i)]
    points = spark.createDataFrame(data, "track_id long, seq int, lat double, lng double")
    got = rows(heatmap.line_tiles(points, list(range(1, 18))).select("track_id", "z", "x", "y"))
    fine = {g for g in got if g[1] == 17}
    assert len(got) == len(set(got)) and set(got) == {(i, z, x >> 17 - z, y >> 17 - z) for i, _, x, y in fine for z in range(1, 18)}
    assert rows(heatmap.line_tiles(points, [3, 17])) == [g for g in got if g[1] in (3, 17)]
    n = 2**17
    own = {(i, int((g + 180) / 360 * n), int((1 - math.log(math.tan(math.radians(a)) + 1 / math.cos(math.radians(a))) / math.pi) / 2 * n)) for i, _, a, g in data if a is not None and g == g}
    assert own <= {(i, x, y) for i, _, x, y in fine}
    plan = heatmap.tile_plan(points, list(range(1, 18)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by track, and the counts


def test_groups_are_clustered_together(spark, monkeypatch):
    """many groups at once, in buckets of any size, as each alone; large groups, small ones and a null key."""
    rng = np.random.RandomState(4)
    sizes = {(1, "Ride"): 40, (1, "Run"): 90, (2, None): 25, (None, "Ride"): 13, (3, "Ride"): 5, (4, "Run"): 12, (5, "Run"): 60}
    data, n = [], 0
    for (athlete, sport), m in sizes.items():
        for _ in range(m):
            n += 1
            data.append((n, athlete, sport, rng.randint(0, 7) / 6.0, float(rng.randint(0, 2) * 0.5 + rng.rand() * 0.1), float(rng.rand() * 0.2), float(rng.rand() * 0.1)))
    f = spark.createDataFrame(data, "activity_id long, athlete long, sport_type string, " + ", ".join(f"{c} double" for c in patterns.FEATURES))
    want = {}
    for key in sizes:
        mine = [r for r in data if r[1:3] == key]
        found = patterns.cluster_group(np.array([r[3:] for r in mine])) if len(mine) >= 12 else None
        if found is not None:
            want.update({r[0]: (*key, int(c), round(float(s), 9)) for r, c, s in zip(mine, *found)})
    assert len({w[:2] for w in want.values()}) > 3
    for pairs, buckets in ((500_000, 64), (3000, 1), (1, 1)):
        monkeypatch.setattr(patterns, "PAIRS", pairs)
        monkeypatch.setattr(patterns, "BUCKETS", buckets)
        got = {r["activity_id"]: (r["athlete"], r["sport_type"], r["cluster"], round(r["silhouette"], 9)) for r in patterns.clusters(f, ["athlete", "sport_type"]).collect()}
        assert got == want
    assert len(patterns.cluster_groups(np.zeros((24, 4)), np.array([12, 12]))) == 2


def test_equal_boxes_meet_once(spark, monkeypatch):
    """boxes are compared as kinds, and what is saved does not depend on how many sections have a box."""
    met = []
    whole = keeping.met_boxes
    monkeypatch.setattr(keeping, "met_boxes", lambda a, b: met.append((a.count(), b.count())) or whole(a, b))
    box = lambda k: (46.0 + k % 2, 46.01 + k % 2, 7.0, 7.01)
    s = [(k, "auto", f"Section {k}", "Ride", k > 30, False, k % 5, *box(k)) for k in range(1, 41)]
    s = [r for r in s if not r[4] or r[0] % 2]  # the accepted ones are at one place
    sections = spark.createDataFrame(s, "section_id long, section_type string, name string, sport_type string, accepted boolean, trimmed boolean, visits long, min_lat double, max_lat double, min_lng double, max_lng double")
    detected = spark.createDataFrame([(100 + k, "Ride", k % 5, *box(k)) for k in range(20)], "det_id long, sport_type string, visits long, min_lat double, max_lat double, min_lng double, max_lng double")
    got = rows(keeping.saved(sections, detected).select("section_id", "name", "visits", "min_lat"))
    assert met == [(2, 1), (1, 2)]
    assert len(got) == 5 + 10 and sum(n == 47.0 for *_, n in got) == 5  # what the accepted ones cover is gone
    ids = sorted(g[0] for g in got if g[3] == 46.0)
    assert ids == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20]


def test_strokes_look_no_wider_than_their_slope(spark):
    """candidates across a stroke follow its slope; a level stroke looks at its own width only."""
    data = [(1, 1, 46.0, 7.0), (1, 2, 46.0, 7.5)]
    df = heatmap.pixel_intensity(spark.createDataFrame(data, "track_id long, seq int, lat double, lng double"), [10])
    assert "across" in df._jdf.queryExecution().analyzed().toString()
    per_column = {}
    for r in df.collect():
        per_column[r["x"] * 512 + r["col"]] = per_column.get(r["x"] * 512 + r["col"], 0) + 1
    assert max(per_column.values()) == 6  # twice the outer radius of 3


def test_strokes_are_added_up_in_their_task(spark, monkeypatch):
    """no row for each pixel of a stroke leaves a task, and all zooms come from one pass; sums as of plain loops, however the strokes are cut."""
    rng = np.random.RandomState(6)
    data = [(i, k + 1, 46 + float(rng.rand()) * 0.3, 7 + float(rng.rand()) * 0.3) for i in range(5) for k in range(8)] + [(8, 1, 85.0, -99.0), (8, 2, 85.2, -98.9), (9, 1, 10.0, -100.0), (9, 2, 10.0, -100.0), (9, 3, 9.5, -93.5), (9, 4, 9.6, -93.45)]
    points = spark.createDataFrame(data, "track_id long, seq int, lat double, lng double")
    df = heatmap.pixel_intensity(points, [2, 5, 9])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and plan.count("Generate") == 2
    got = {(r["z"], r["x"] * 512 + r["col"], r["y"] * 512 + r["row"]): r["intensity"] for r in df.collect()}
    want = {}
    for z in (2, 5, 9):
        most, radius, intensity = 512 * 2**z, heatmap.of_zoom(heatmap.WIDTHS, z) / 2, heatmap.of_zoom(heatmap.INTENSITIES, z)
        px = [(i, (g + 180) / 360 * most, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * most) for i, _, a, g in data for r in [math.radians(min(a, 85.051129))]]
        for (i, ax, ay), (j, bx, by) in zip(px, px[1:]):
            if i != j:
                continue
            dx, dy = bx - ax, by - ay
            gx, gy = (np.arange(math.floor(min(a, b)) - 5, math.ceil(max(a, b)) + 6) + 0.5 for a, b in ((ax, bx), (ay, by)))
            u, v = gx[:, None] - ax, gy - ay
            t = np.clip((u * dx + v * dy) / (dx * dx + dy * dy), 0, 1) if dx * dx + dy * dy > 0.0001 else 0.0
            edge = np.clip(np.hypot(u - t * dx, v - t * dy) - radius, 0, 1)
            add = np.floor(intensity * (1 - edge * edge * (3 - 2 * edge)) + 0.5).astype(int)
            for k, m in zip(*np.nonzero(add)):
                if 0 <= gx[k] < most and 0 <= gy[m] < most:
                    key = (z, int(gx[k]), int(gy[m]))
                    want[key] = want.get(key, 0) + int(add[k, m])
    assert got == want
    cut = {}
    monkeypatch.setattr(heatmap, "COLUMNS", 50)
    monkeypatch.setattr(heatmap, "KEPT", 300)
    for b in heatmap._drawn(heatmap.strokes(points, [2, 5, 9]).toArrow().to_batches(max_chunksize=7)):
        for z, x, y, n in zip(*(b.column(c).to_pylist() for c in ("z", "gx", "gy", "value"))):
            cut[z, x, y] = cut.get((z, x, y), 0) + n
    assert cut == want
