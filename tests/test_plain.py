"""Registered queries that SQL cannot express, against plain loops over the same rows."""

import functools
import hashlib
import math
import operator
import os
import struct
import zlib

import pytest
from stridelake.operators import heatmap, patterns
from stridelake.plans import heatmap as heatmap_plans
from stridelake.plans import patterns as patterns_plans
from stridelake.plans import registry
from stridelake.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def farthest(x, y, a, b):
    """The point between a and b that is farthest from the line through them, and its distance."""
    best, at = -1.0, None
    length = math.hypot(x[b] - x[a], y[b] - y[a])
    for i in range(a + 1, b):
        d = abs((x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a])) / length if length else math.hypot(x[i] - x[a], y[i] - y[a])
        if d > best:
            best, at = d, i
    return at, best


def kept(lats, lngs, tolerance):
    y = [v * 111_194.9 for v in lats]
    x = [v * 111_194.9 * math.cos(math.radians(sum(lats) / len(lats))) for v in lngs]

    def between(a, b):
        at, d = farthest(x, y, a, b) if b - a > 1 else (None, 0.0)
        return between(a, at) + [at] + between(at, b) if d > tolerance else []

    return sorted({0, len(x) - 1} | set(between(0, len(x) - 1)))


def test_simplified_tracks(spark):
    days = {}
    for r in Tables(spark, SF).points.orderBy("track_id", "t", "point_id").collect():
        days.setdefault((r["track_id"], r["t"] // 86400), []).append((r["lat"], r["lng"]))
    got = {(r["track_id"], r["day"]): (r["points"], list(r["kept"])) for r in registry.QUERIES["f_simplified_tracks"](spark, SF).collect()}
    assert got == {k: (len(v), kept(*zip(*v), 100.0)) for k, v in days.items()} and any(len(v) > 2 for v in days.values())


def picture(lit):
    """The PNG of a tile from its lit pixels {(row, col): intensity}, pixel by pixel."""
    size, raw = heatmap.SIZE, bytearray()
    at = lambda r, c: lit.get((min(max(r, 0), size - 1), min(max(c, 0), size - 1)), 0)
    near = {(r + i, c + j) for r, c in lit for i in (-1, 0, 1) for j in (-1, 0, 1)}
    stops = heatmap.GRADIENT

    def colour(v):
        share = 1 - math.exp(-v / 90.0)
        k = max(i for i, s in enumerate(stops[:-1]) if s[0] <= share or i == 0)
        part = (share - stops[k][0]) / (stops[k + 1][0] - stops[k][0])
        return [stops[k][c] + (stops[k + 1][c] - stops[k][c]) * part for c in range(1, 5)]

    blank = bytes(int(v + 0.5) for v in colour(0))
    for r in range(size):
        raw.append(0)
        for c in range(size):
            if (r, c) in near:
                total = sum((2 - abs(i)) * (2 - abs(j)) * at(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1))
                raw += bytes(round(v) for v in colour(total / 16))
            else:
                raw += blank
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(raw))) + part(b"IEND", b"")


def test_rendered_tiles(spark):
    """Pixels come from the operator that h4 checks against SQL; blur, exposure, colours and the file are plain here."""
    lit = {}
    for r in heatmap.pixel_intensity(heatmap_plans.tracks(Tables(spark, SF)), [9]).collect():
        lit.setdefault((r["z"], r["x"], r["y"]), {})[r["row"], r["col"]] = r["intensity"]
    got = {(r["z"], r["x"], r["y"]): (r["lit"], r["bytes"], r["digest"]) for r in registry.QUERIES["h5_h6_rendered_tiles"](spark, SF).collect()}
    want = {k: picture(v) for k, v in lit.items()}
    assert got == {k: (len(lit[k]), len(p), hashlib.sha256(p).hexdigest()) for k, p in want.items()} and got


def test_clusters_are_settled(spark):
    """Each row lies nearest to the mean of its own cluster, its silhouette is that of plain loops, and the group's mean reaches the least."""
    features = {r["activity_id"]: [r[c] for c in patterns.FEATURES] for r in patterns_plans.features(Tables(spark, SF)).collect()}
    groups = {}
    for r in registry.QUERIES["g22_g23_clusters"](spark, SF).collect():
        groups.setdefault((r["athlete"], r["sport_type"]), []).append((features[r["activity_id"]], r["cluster"], r["silhouette"]))
    assert groups
    for rows in groups.values():
        members = {c: [x for x, k, _ in rows if k == c] for c in {k for _, k, _ in rows}}
        means = {c: [sum(v) / len(m) for v in zip(*m)] for c, m in members.items()}
        for x, c, s in rows:
            assert math.dist(x, means[c]) <= min(math.dist(x, m) for m in means.values()) + 1e-9
            own = [math.dist(x, y) for y in members[c]]
            inner = sum(own) / (len(own) - 1) if len(own) > 1 else 0.0
            outer = min(sum(math.dist(x, y) for y in m) / len(m) for k, m in members.items() if k != c)
            assert s == pytest.approx((outer - inner) / max(outer, inner) if len(own) > 1 else 0.0, abs=1e-9)
        assert sum(s for *_, s in rows) / len(rows) >= patterns.MIN_SILHOUETTE


def test_a_thousand_that_is_met_exactly(spark):
    """2,500 times 0.4, which as doubles add up to a little less."""
    from types import SimpleNamespace

    assert functools.reduce(operator.add, [0.4] * 2500) < 1000
    points = spark.createDataFrame([(1, i, i, 0.4) for i in range(1, 2502)], "track_id long, point_id long, t long, value double")
    assert [tuple(r) for r in registry.OVER_TABLES["w26_split_times"](SimpleNamespace(points=points)).collect()] == [(1, 1, 2500)]
