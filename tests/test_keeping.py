"""Upkeep of sections: saved detections, numbering, consensus states and the index of new tracks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from stridelake.operators import keeping, order
from stridelake.operators.detection import DetectionConfig, route_groups
from stridelake.sources.folders import BucketTable, shared_folder
from stridelake.streaming.indexing import POINTS, TrackIndex

SECTIONS = "section_id long, section_type string, name string, sport_type string, accepted boolean, trimmed boolean, visits long, min_lat double, max_lat double, min_lng double, max_lng double"
DETECTED = "det_id long, sport_type string, visits long, min_lat double, max_lat double, min_lng double, max_lng double"


def box(rng, size=0.02):
    y, x = rng.choice([46.0, 46.01, 46.1]) + rng.random() * 0.01, rng.choice([7.0, 7.05]) + rng.random() * 0.01
    return y, y + size * (0.5 + rng.random()), x, x + size * (0.5 + rng.random())


def shared(a, b):
    side = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
    return side[0] * side[1] if min(side) > 0 else 0.0


def size(a):
    return (a[1] - a[0]) * (a[3] - a[2])


def plain_saved(sections, detected):
    stays = [s for s in sections if s[1] != "auto" or s[4] or s[5]]
    old = [s for s in sections if s not in stays]
    fresh = [d for d in detected if not any(s[4] and shared(d[3:], s[7:]) / size(d[3:]) > 0.45 for s in stays)]
    pairs = []
    for d in fresh:
        for s in old:
            both = shared(d[3:], s[7:])
            same = round(both / (size(d[3:]) + size(s[7:]) - both), 12)
            if d[1] == s[3] and same >= 0.5:
                pairs.append((-same, abs(d[2] - s[6]), s[0], d[0]))
    heir = {}
    for _, _, s, d in sorted(pairs):
        if d not in heir and s not in heir.values():
            heir[d] = s
    names = {s[0]: s[2] for s in old}
    taken = {int(n.split()[-1]) for n in [s[2] for s in stays] + [names[s] for s in heir.values()] if n and n.split()[-1].isdigit() and n.split()[-2] == "Section"}
    free, last, out = (n for n in range(1, 10_000) if n not in taken), max((s[0] for s in sections), default=0), list(stays)
    for d in sorted(fresh, key=lambda d: (d[1], -d[2], d[0])):
        name = names.get(heir.get(d[0])) or f"Section {next(free)}"
        if d[0] not in heir:
            last += 1
        out.append((heir.get(d[0], last), "auto", name, d[1], False, False, d[2], *d[3:]))
    return sorted(out)


def test_saved_sections(spark):
    rng = random.Random(1)
    name = lambda i: rng.choice([None, f"Section {i % 9 + 1}", f"Ride Section {i}", "Home hill", "Section x"])
    sections = [(i, rng.choice(["auto", "auto", "custom"]), name(i), rng.choice(["Ride", "Run"]), rng.random() < 0.1, rng.random() < 0.1, rng.randint(0, 5), *box(rng)) for i in range(1, 60)]
    detected = [(i, rng.choice(["Ride", "Run"]), rng.randint(0, 5), *box(rng)) for i in range(40)]
    detected += [(100 + s[0], s[3], s[6], *s[7:]) for s in sections[:15]] + [(200, "Hike", 1, 46.0, 46.5, 7.0, 7.5)]
    s, d = spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(detected, DETECTED)
    once = keeping.saved(s, d)
    got = sorted(tuple(r) for r in once.collect())
    assert got == plain_saved(sections, detected)
    assert len({r[0] for r in got}) == len(got)
    assert set(map(tuple, s.filter(keeping.stays()).collect())) <= set(got)
    assert sorted(tuple(r) for r in keeping.saved(once, d).collect()) == got  # saving again changes nothing
    assert sorted(tuple(r) for r in keeping.saved(s.limit(0), d.limit(0)).collect()) == []
    t = spark.createDataFrame([(r[0], r[0] * 10) for r in sections], "section_id long, activity_id long")
    kept = keeping.saved_traversals(t, s, spark.createDataFrame([(r[0], 1) for r in got], "section_id long, activity_id long")).collect()
    held = {r[0] for r in sections if r[1] != "auto" or r[4] or r[5]}
    assert {tuple(r) for r in kept} == {(i, i * 10) for i in held} | {(r[0], 1) for r in got if r[0] not in held}


def test_numbers_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 20), rng.randint(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v int").repartition(7)
    got = {r["id"]: (r["n"], r["s"]) for r in order.numbered(order.running(df, F.col("v"), "s", "k", F.desc("id")), "n", "k", F.desc("id")).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], -r[0])), 1):
        total += v
        assert got[i] == (n, total)
    for taken in ([], [1, 2, 3], [2, 5, 6, 7, 40], [0, -3, 10**6]):
        t = spark.createDataFrame([(n,) for n in taken], "n long")
        found = order.with_free_numbers(spark.range(1, 12).withColumnRenamed("id", "place"), "place", t, "number").orderBy("place").collect()
        free = [n for n in range(1, 60) if n not in taken]
        assert [r["number"] for r in found] == free[:11]


def test_matching_is_greedy(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(70)})
    rows = [(a, b, rng.randint(0, 4)) for a, b in pairs]
    used_a, used_b, want = set(), set(), set()
    for w, b, a in sorted((w, b, a) for a, b, w in rows):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    df = spark.createDataFrame(rows, "a int, b int, w int")
    assert {tuple(r) for r in keeping.matched(df, "a", "b", F.col("w")).collect()} == want
    assert keeping.matched(df.limit(0), "a", "b", F.col("w")).count() == 0


def test_consensus_states_add_and_subtract(spark):
    rng = random.Random(4)
    fixes = [(rng.randint(1, 4), a, rng.randint(0, 1), 46 + rng.random() / 100, 7 + rng.random() / 100) for a in range(30) for _ in range(20)] + [(1, 3, 0, None, 7.0)]
    df = spark.createDataFrame(fixes, "section_id long, activity_id long, start_index int, lat double, lng double")
    rows = lambda s: sorted(tuple(r) for r in s.select(*keeping.STATE, *keeping.FIGURES).collect())
    whole = keeping.contributions(df, 0.002)
    state = whole.limit(0)
    for k in range(4):
        state = keeping.accumulated(state, keeping.contributions(df.filter(F.col("activity_id") % 4 == k), 0.002))
    assert rows(state) == rows(whole)
    gone = df.filter("activity_id < 9")
    assert rows(keeping.accumulated(whole, whole.limit(0), keeping.contributions(gone, 0.002))) == rows(keeping.contributions(df.filter("activity_id >= 9"), 0.002))
    assert rows(keeping.accumulated(whole, whole.limit(0), whole)) == []
    sections = spark.createDataFrame([(i, i == 4) for i in range(1, 6)], "section_id long, disabled boolean")
    part = whole.filter("section_id = 1")
    assert rows(keeping.backfilled(part, sections, df, 0.002)) == rows(whole.filter("section_id < 4"))
    mean = {(r["section_id"], r["y"], r["x"]): (r["lat"], r["tracks"]) for r in keeping.consensus_of(whole, 2).collect()}
    for key, (lat, tracks) in mean.items():
        here = [f for f in fixes if f[3] and (f[0], int(f[3] // 0.002), int(f[4] // 0.002)) == key]
        assert abs(lat - sum(f[3] for f in here) / len(here)) < 1e-6 and tracks == len({f[1:3] for f in here}) >= 2


def tracks_of(rng, ids):
    """Tracks along two corridors with some noise, and short ones."""
    out = []
    for i in ids:
        lat, step = rng.choice([46.0, 46.1]), rng.choice([1, 1, -1])
        n = rng.choice([2, 30, 30, 40])
        for k in range(n):
            at = k if step > 0 else n - k
            out.append((i, rng.choice(["Ride"]) if i % 3 else "Run", k + 1, 1_700_000_000 + i * 10_000 + k * 10, lat + at * 0.0009 + rng.random() * 1e-4, 7.0 + rng.random() * 1e-4))
    return out


def test_index_follows_a_stream(spark, tmp_path):
    rng = random.Random(5)
    lines = [(s, p, lat + p * 0.0009, 7.00005) for s, lat, start, end in ((1, 46.0, 3, 12), (2, 46.0, 8, 25), (3, 46.1, 0, 20), (4, 46.5, 0, 9)) for p in range(start, end)]
    polylines = spark.createDataFrame(lines, "section_id long, point int, lat double, lng double")
    sections = spark.createDataFrame([(1, "Ride", 900.0), (2, "Ride", 1600.0), (3, "Run", 1900.0), (4, "Ride", 800.0)], "section_id long, sport_type string, section_meters double")
    cfg = DetectionConfig()
    new = lambda: TrackIndex(spark, shared_folder(spark, "test-index"), sections, polylines, cfg)
    state = lambda x: [sorted(map(str, t.read().collect())) for t in (x.traversals, x.groups, x.indicators)]
    batches = [tracks_of(rng, range(8)), tracks_of(rng, range(8, 12)), tracks_of(rng, [3, 9])]  # the last two come again, changed
    index, seen = new(), {}
    source = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(source)
        index.follow(spark.readStream.schema(POINTS).parquet(source), str(tmp_path / "at")).awaitTermination()
        seen.update({i: [r for r in rows if r[0] == i] for i in {r[0] for r in rows}})
        now = state(index)
        if not k:
            continue
        rebuilt = new()
        rebuilt.index(spark.createDataFrame([r for rows in seen.values() for r in rows], POINTS))
        assert now == state(rebuilt) and now[0]
    index.index(spark.createDataFrame(batches[-1], POINTS))  # once more
    assert state(index) == now
    points = spark.createDataFrame([r for rows in seen.values() if len(rows) > 2 for r in rows], POINTS)
    assert now[1] == sorted(map(str, route_groups(points, cfg).collect()))


def test_bucket_table(spark):
    t = BucketTable(spark, shared_folder(spark, "test-buckets"), "k", "k long, v string", 4)
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(t.read()) == [] == rows(t.rows_of(df([(1, "")])))
    t.replace(df([(k, "") for k in range(6)]), df([(k, "a") for k in range(6)] + [(1, "b")]))
    t.replace(df([(1, ""), (2, ""), (9, "")]), df([(9, "c"), (1, "d")]))
    want = [(0, "a"), (1, "d"), (3, "a"), (4, "a"), (5, "a"), (9, "c")]
    assert rows(t.read()) == want and rows(t.rows_of(df([(1, ""), (2, "")]))) == [(1, "d")]
    t.replace(df([(k, "") for k in range(10)]), df([]))
    assert rows(t.read()) == []
    with pytest.raises(TypeError):
        BucketTable(spark)
