"""Live recordings: cleaning of fixes, held sensor values, auto-pause; as streams and as batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.functions.scalar import EARTH_M, max_plausible_speed

OUT = "track_id long, t long, lat double, lng double, step_m double, total_m double"
STATE = "t long, lat double, lng double, total_m double"


def distance(a_lat: float, a_lng: float, b_lat: float, b_lng: float) -> float:
    p, q = math.radians(a_lat), math.radians(b_lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b_lng - a_lng) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(h, 1.0)))


def clean(fixes, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Fixes (t, lat, lng, limit) that are later than the last kept one and no jump from it, with step and total.

    A dropped fix changes what the next one is measured from, so this is a
    fold over the recording and not a window.
    """
    out = []
    for t, lat, lng, limit in fixes:
        if state is None:
            step, total = 0.0, 0.0
        else:
            if t <= state[0]:
                continue
            step = distance(state[1], state[2], lat, lng)
            if step / (t - state[0]) > limit:
                continue
            total = state[3] + step
        state = (t, lat, lng, total)
        out.append((t, lat, lng, step, total))
    return out, state


def _frame(track_id, rows) -> pd.DataFrame:
    return pd.DataFrame([(track_id, *r) for r in rows], columns=["track_id", "t", "lat", "lng", "step_m", "total_m"])


def _fold(rows: DataFrame, order: list[str], step, schema: str) -> DataFrame:
    """A fold over each track in order, batch by batch: step(rows of one track, state) gives output rows and the next state.

    Rows are sorted on disk if need be and stream through; only the state of
    the track at hand is kept, so a track of any length fits.
    """

    def run(batches):
        track, state = None, None
        for batch in batches:
            pdf, out = batch.to_pandas(), []
            for key, part in pdf.groupby("track_id", sort=False):
                if key != track:
                    track, state = key, None
                made, state = step(part, state)
                out += [(key, *r) for r in made]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return rows.repartition(F.xxhash64("track_id")).sortWithinPartitions("track_id", *order).mapInArrow(run, schema)


def cleaned_batch(points: DataFrame) -> DataFrame:
    """The cleaning over stored recordings (track_id, t, lat, lng, sport_type, point_id)."""
    rows = points.filter("lat is not null and lng is not null and t is not null").withColumn("limit", max_plausible_speed(F.col("sport_type")))
    return _fold(rows.select("track_id", "point_id", "t", "lat", "lng", "limit"), ["point_id"], lambda p, state: clean(zip(p["t"], p["lat"], p["lng"], p["limit"]), state), OUT)


def cleaned_stream(points: DataFrame, idle_s: int = 6 * 3600) -> DataFrame:
    """The same over a stream: the last kept fix of each recording is the state, which goes after an idle time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else None
        for pdf in frames:
            rows, last = clean(zip(pdf["t"], pdf["lat"], pdf["lng"], pdf["limit"]), last)
            yield _frame(key[0], rows)
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(idle_s * 1000)

    rows = points.filter("lat is not null and lng is not null and t is not null").withColumn("limit", max_plausible_speed(F.col("sport_type")))
    return rows.groupBy("track_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def accurate(points: DataFrame, limit_m: float = 30.0) -> DataFrame:
    """Fixes whose accuracy is unknown or within the limit."""
    return points.filter(F.col("accuracy").isNull() | (F.col("accuracy") <= limit_m))


def sample_and_hold(points: DataFrame, sampled: Column, value: str, fresh_s: int) -> DataFrame:
    """For each fix the sensor's latest value, 0 once that is older than fresh_s (null before the first)."""
    w = Window.partitionBy("track_id").orderBy("t", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.last(F.when(sampled, F.col(value)), ignorenulls=True).over(w)
    at = F.last(F.when(sampled, F.col("t")), ignorenulls=True).over(w)
    rows = points.withColumn("v", v).withColumn("at", at)
    return rows.select("track_id", "point_id", F.when(F.col("t") - F.col("at") <= fresh_s, F.col("v")).otherwise(0.0).alias("held"))


def auto_pause(points: DataFrame, speed: str, threshold: float, after_s: int, resume: float = 1.25) -> DataFrame:
    """Pauses and resumes of each recording: below the threshold for after_s seconds, then at least resume times it."""

    def step(part: pd.DataFrame, state: tuple | None):
        paused, since = state or (False, None)
        out = []
        for t, v in zip(part["t"].tolist(), part[speed].tolist()):
            if paused:
                if v >= threshold * resume:
                    paused, since = False, None
                    out.append((t, "resume"))
            elif v < threshold:
                since = t if since is None else since
                if t - since >= after_s:
                    paused = True
                    out.append((t, "pause"))
            else:
                since = None
        return out, (paused, since)

    return _fold(points.select("track_id", "t", "point_id", speed), ["t", "point_id"], step, "track_id long, t long, event string")


def live_metrics(points: DataFrame) -> DataFrame:
    """Running figures of each recording, for complete or update mode."""
    return points.groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), (F.max("t") - F.min("t")).alias("elapsed"), F.max("value").alias("top"))
