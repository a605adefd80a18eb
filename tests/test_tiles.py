"""Kept tiles are those of a full render, byte for byte; the pace milestone's gates."""

import random

from pyspark.sql import functions as F

from stridelake.operators import fitness
from stridelake.sources.tiles import TileStore

POINTS = "track_id long, seq int, lat double, lng double"


def track(i, rng):
    lat, lng = rng.choice([(46.0, 7.0), (46.3, 7.4), (-33.0, 151.0)]) if i != 2 else (10.0, 10.0)
    return [(i, k, lat := lat + rng.uniform(-0.004, 0.006), lng := lng + rng.uniform(-0.004, 0.006)) for k in range(12)]


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.glob("[0-9]*/*/*.png")}


def test_kept_tiles_equal_a_full_render(spark, tmp_path):
    rng, zooms = random.Random(1), [6, 9, 12]
    old, new = [r for i in range(6) for r in track(i, rng)], track(6, rng)
    frame = lambda rows: spark.createDataFrame(rows, POINTS)
    kept = TileStore(spark, str(tmp_path / "kept"), zooms)
    assert kept.is_dirty() and kept.refresh(frame(old)) > 0 and not kept.is_dirty() and kept.refresh(frame(old)) == 0
    before = files(tmp_path / "kept")
    now = [r for r in old if r[0] != 2] + new
    kept.mark(frame(new))
    kept.mark(frame([r for r in old if r[0] == 2]))
    assert kept.is_dirty() and kept.refresh(frame(now)) > 0 and not kept.is_dirty()
    TileStore(spark, str(tmp_path / "full"), zooms).refresh(frame(now))
    after = files(tmp_path / "kept")
    assert after == files(tmp_path / "full") and after != before and before.keys() - after.keys()
    assert TileStore(spark, str(tmp_path / "kept"), zooms, "2").is_dirty()


def test_pace_milestone(spark):
    rows = [(3.0, 2.9), (3.0, 2.999), (2.0, 2.5), (3.0, None), (3.0, 0.0)]
    df = spark.createDataFrame(rows, "latest double, previous double")
    got = [tuple(r) for r in fitness.pace_milestone(df, 1000).select("latest", "previous", F.col("gain_secs").cast("int"), F.col("gain_percent").cast("int")).collect()]
    assert got == [(3.0, 2.9, 11, 3)]
