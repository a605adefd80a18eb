"""The flow graph against a plain walk: forks, rings, ties, and turns that are added up."""

import random

from stridelake.operators import flows
from stridelake.operators.detection import DetectionConfig

POINTS = "track_id long, seq int, lat double, lng double"


def plain_turns(walks):
    count = {}
    for cells in walks.values():
        steps = [c for c, was in zip(cells, [None, *cells]) if c != was]
        for turn in set(zip(steps, steps[1:], steps[2:])):
            count[turn] = count.get(turn, 0) + 1
    return count


def plain_sections(count, least):
    kept = {t: n for t, n in count.items() if n >= least}
    out, into = {}, {}
    for (a, b, c), n in kept.items():
        out[a, b] = max(out.get((a, b), (0, 0)), (n, -c))
        into[b, c] = max(into.get((b, c), (0, 0)), (n, -a))
    after = {(a, b): (b, c) for (a, b, c), n in kept.items() if out[a, b] == (n, -c) and into[b, c] == (n, -a)}
    edges, left = set(after) | set(after.values()), dict(after)
    seen = set()
    for e in sorted(edges):  # rings are cut before their smallest edge
        at, ring = left.get(e), [e]
        while at and at != e and at not in ring:
            ring.append(at)
            at = left.get(at)
        if at == e and e == min(ring) and e not in seen:
            del left[ring[-1]]
        seen |= set(ring) if at == e else set()
    found = []
    for head in edges - set(left.values()):
        path, weights = [head], []
        while path[-1] in left:
            nxt = left[path[-1]]
            weights.append(kept[path[-1][0], path[-1][1], nxt[1]])
            path.append(nxt)
        if len(path) + 1 > 2:
            found.append((head[0], path[-1][1], len(path) + 1, min(weights), max(weights)))
    return sorted(found)


def walk(rng, n):
    """A walk on a small torus of cells that mostly goes straight on."""
    y, x, dy, dx, out = rng.randint(0, 5), rng.randint(0, 5), 0, 1, []
    for _ in range(n):
        out.append((y, x))
        if rng.random() < 0.3:
            dy, dx = rng.choice([(0, 1), (1, 0), (0, -1), (-1, 0), (0, 0)])
        y, x = (y + dy) % 6, (x + dx) % 6
    return out


def test_sections_of_flows(spark):
    rng, deg = random.Random(1), 0.01
    walks = {i: walk(rng, rng.randint(0, 40)) for i in range(60)}
    for i in range(60, 64):  # a ring of its own
        walks[i] = [(20, 20), (20, 21), (21, 21), (21, 20)] * 3
    rows = [(i, k, (y + 0.5) * deg, (x + 0.5) * deg) for i, w in walks.items() for k, (y, x) in enumerate(w)] + [(1, 99, None, 0.0)]
    points = spark.createDataFrame(rows, POINTS).repartition(3)
    code = lambda c: int((c[0] + 0.5) * deg / deg + 9000) * 10**9 + int((c[1] + 0.5) + 18000)
    count = plain_turns({i: [code(c) for c in w] for i, w in walks.items()})
    turns = flows.turns(points, deg)
    assert {tuple(r)[:3]: r[3] for r in turns.collect()} == count
    for least in (2, 3, 4):
        cfg = DetectionConfig(cell_deg=deg, least_tracks=least)
        assert sorted(tuple(r) for r in flows.flow_sections(turns, cfg).collect()) == plain_sections(count, least)
    cfg = DetectionConfig(cell_deg=deg)
    known = points.filter("track_id >= 25")
    merged = flows.detected_with_new(points, flows.turns(known, deg), known.select("track_id").distinct(), cfg, batch=7)
    assert {tuple(r)[:3]: r[3] for r in merged.collect()} == count
    few = points.filter("track_id < 10")
    assert flows.detected_with_new(points, flows.turns(few, deg), few.select("track_id").distinct(), cfg).exceptAll(turns).isEmpty()
    assert flows.flow_sections(turns.limit(0), cfg).count() == 0


def test_route_groups_by_blocks(spark, monkeypatch):
    """as by all pairs, while only blocks of tracks are joined."""
    import math
    import random

    from stridelake.operators import detection, upkeep

    rng, found, join = random.Random(4), [], detection.radius_join

    def counting(*args):
        out = join(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(detection, "radius_join", counting)
    spots = [(46 + rng.random() * 0.04, 7 + rng.random() * 0.04) for _ in range(60)] + [(46.0, 7.5), (46.0005, 7.5005)] * 150
    rows = [(i, *p, 46.2 + rng.choice([0, 0, 0.004]), 7.2, rng.choice([1000.0, 1300.0, 1500.0, 3000.0]), 5) for i, p in enumerate(spots)]

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows[: a[0]]:
            if min(a[5], b[5]) / max(a[5], b[5]) >= 0.8 and metres(*a[1:3], *b[1:3]) <= 500 and metres(*a[3:5], *b[3:5]) <= 500:
                x, y = sorted((top(a[0]), top(b[0])))
                root[y] = x
    want = [(i, top(i)) for i in range(len(rows))]
    sigs = spark.createDataFrame(rows, "track_id long, lat double, lng double, end_lat double, end_lng double, metres_long double, points long")
    cfg = detection.DetectionConfig()
    assert sorted(tuple(r) for r in detection.grouped(sigs, cfg).collect()) == want and len({r for _, r in want}) > 20
    old = detection.grouped(sigs.filter("track_id % 3 > 0"), cfg)
    assert sorted(tuple(r) for r in upkeep.regrouped(sigs, old, cfg).collect()) == want
    assert max(found) < 20_000  # all pairs of tracks in reach are over 45,000


def test_batches_in_one_pass(spark):
    """thirty batches of new tracks are counted by as many jobs as one."""
    pts = spark.createDataFrame([(i, k, 46.0, 7 + 0.02 * (k + i % 4)) for i in range(100) for k in range(6)], "track_id long, seq int, lat double, lng double")
    known = pts.filter("track_id >= 40")
    cfg, sc, jobs = DetectionConfig(cell_deg=0.02), spark.sparkContext, []
    for batch in (1, 40):
        sc.setJobGroup(f"batch {batch}", "")
        got = flows.detected_with_new(pts, flows.turns(known, 0.02), known.select("track_id").distinct(), cfg, batch=batch)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"batch {batch}")))
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in flows.turns(pts, 0.02).collect())
    sc.setJobGroup("", "")
    assert jobs[0] <= jobs[1] + 2
