"""Live figures: the stream's last update is the batch, and both are what the whole arrays of a recording give."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.streaming import live


def recording(i, rng):
    """Samples with pauses, dropouts, time-only samples and laps."""
    rows, t, paused, distance = [], 0.0, 0.0, 0.0
    for k in range(rng.randint(1, 80)):
        t += rng.choice([0.0, 1.0, 1.0, 2.5])
        distance += rng.random() * 5
        kind = rng.choices(["sample", "indoor", "lap", "odd"], [8, 2, 1, 0.2])[0]
        if rng.random() < 0.1:
            t, paused = t + 7.4, paused + 7.4
        value = lambda low, high: rng.choice([None, float("nan"), 0.0] + [rng.uniform(low, high)] * 5)
        rows.append((i, k, kind, t, paused, value(0, 9), distance, value(0, 500), value(80, 180), value(0, 400), value(0, 100), rng.choice([None, "Ride"]) if i % 2 else None, 62.5 if i % 3 else None))
    return rows


def plain(rows):
    """The figures from whole arrays, as an app keeps them."""
    num = lambda x: 0.0 if x is None or not math.isfinite(x) else x
    times, dist, alt, hr, last, laps, paused, sport, weight = [], [], [], [], (0.0, 0.0, 0.0), [], 0.0, None, None
    for _, _, kind, t, p, speed, d, a, h, w, c, s, kg in sorted(rows, key=lambda r: (r[3], r[1])):
        if kind == "odd":
            continue
        paused, sport, weight = max(paused, p), s or sport, kg or weight
        if kind == "lap":
            laps.append(t - paused)
        elif kind == "sample" or not times or t > times[-1]:
            indoor = kind == "indoor"
            times.append(t), dist.append((dist[-1] if dist else 0.0) if indoor else d), hr.append(num(h))
            alt.append(0.0 if indoor else a), (last := (0.0 if indoor else num(speed), num(w), num(c)))
    if not times:
        return None
    heights = [a for a in alt if a is not None and math.isfinite(a)]
    beats, kg = [h for h in hr if h > 0], weight or 70.0
    if len(beats) >= 30:
        kcal = max(0, (-55.0969 + 0.6309 * sum(beats) / len(beats) + 0.1988 * kg + 0.2017 * 35) / 4.184) * times[-1] / 60
    else:
        kcal = times[-1] / 3600 * kg * (8 if sport == "Ride" else 6)
    start = next((d for t, d in zip(times, dist) if t >= laps[-1]), 0.0) if laps else 0.0
    return (
        len(times), times[-1], last[0], dist[-1] / times[-1] if times[-1] else 0.0, dist[-1], hr[-1], *last[1:], num(alt[-1]), sum(max(0.0, b - a) for a, b in zip(heights, heights[1:])),
        1000 / last[0] if last[0] else 0.0, 1000 / (dist[-1] / times[-1]) if times[-1] and dist[-1] else 0.0, math.floor(kcal + 0.5), len(laps), dist[-1] - start, max(0.0, times[-1] - math.floor(paused) - (laps[-1] if laps else 0.0)),
    )


def near(a, b):
    return len(a) == len(b) and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))


def test_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = {i: recording(i, rng) for i in range(25)}
    want = {i: p for i, r in rows.items() if (p := plain(r))}
    df = spark.createDataFrame([r for x in rows.values() for r in x] + [(None, 1, "sample", 1.0) + (None,) * 9], live.SAMPLES)
    got = {r[0]: tuple(r)[1:] for r in live.live_batch(df).collect() if r["samples"]}
    assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)

    source = str(tmp_path / "in")
    for at, end in ((0, 20), (20, 45), (45, 99)):
        df.filter(F.col("seq").between(at, end - 1)).coalesce(2).write.mode("append").parquet(source)
        q = live.live_stream(spark.readStream.schema(live.SAMPLES).parquet(source), None).writeStream.outputMode("update").foreachBatch(
            lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        last[r["recording"]] = tuple(r)[1:-1]
    last = {i: r for i, r in last.items() if r[0]}
    assert last.keys() == want.keys() and all(near(last[i], want[i]) for i in want)


def test_indoor_rows_hold_fresh_values(spark):
    times = spark.createDataFrame([(1, k, float(k)) for k in range(10)], "recording long, seq long, t double")
    sensors = spark.createDataFrame([(1, 2.0, "heartrate", 120.0), (1, 3.5, "heartrate", -1.0), (1, 4.0, "power", float("inf")), (1, 5.0, "power", 210.0), (1, 9.0, "heartrate", 140.0)], "recording long, t double, kind string, value double")
    got = {r["seq"]: (r["heartrate"], r["power"], r["cadence"]) for r in live.indoor_rows(times, sensors, 3.0).collect()}
    assert got == {k: (120.0 if 2 <= k <= 5 else 140.0 if k == 9 else 0.0, 210.0 if 5 <= k <= 8 else 0.0, 0.0) for k in range(10)}


def test_met():
    assert [live.met(s) for s in ("VirtualRide", "Treadmill", "Walk", "OpenWaterSwim", "Yoga", None)] == [8, 10, 4, 7, 6, 6]


def test_a_recording_of_two_sources_is_one(spark):
    """sides of a union that are dealt by recording already, but may be cut differently, are dealt anew."""
    df = spark.createDataFrame(recording(1, random.Random(8)), live.SAMPLES)
    w = Window.partitionBy("recording").orderBy("t", "seq")
    side = lambda where: df.filter(where).withColumn("seq", F.col("seq") + 0 * F.row_number().over(w))
    got = live.live_batch(side("kind <> 'lap'").unionByName(side("kind = 'lap'")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[: plan.index("Union")] and got.count() == 1
