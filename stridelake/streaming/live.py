"""Live figures of recordings: one fold, over a stream with keyed state and timeouts, or over stored recordings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows in order of t, then seq. kind is 'sample', 'indoor' (no position: only time and sensors) or 'lap' (the button);
#: t is the elapsed time in seconds with pauses, paused the seconds of pauses until then.
SAMPLES = "recording long, seq long, kind string, t double, paused double, speed double, distance double, altitude double, heartrate double, power double, cadence double, sport_type string, weight_kg double"
FIGURES = (
    "recording long, samples long, elapsed double, speed double, avg_speed double, distance double, heartrate double, power double, cadence double, elevation double, elevation_gain double, "
    "pace double, avg_pace double, calories long, laps long, lap_distance double, lap_time double"
)
STATE = (
    "samples long, t double, paused double, speed double, distance double, heartrate double, power double, cadence double, altitude double, gain double, last_altitude double, hr_sum double, hr_n long, "
    "laps long, lap_end double, lap_from double, sport_type string, weight_kg double, recent_t array<double>, recent_d array<double>"
)
# Weight where none is known, metabolic equivalents by words in a sport's name, and the heart-rate regression.
WEIGHT_KG = 70.0
MET = [(("ride", "cycling", "bike"), 8.0), (("run", "treadmill"), 10.0), (("walk", "hike"), 4.0), (("swim",), 7.0), (("",), 6.0)]
HR_SAMPLES, HR_TERMS, AGE = 30, (-55.0969, 0.6309, 0.1988, 0.2017), 35


def met(sport: str | None) -> float:
    name = (sport or "").lower()
    return next(v for words, v in MET if any(w in name for w in words))


def _number(x) -> float | None:
    """A sensor's value; None where there is none."""
    return None if x is None or not math.isfinite(x) else float(x)


@dataclass
class Live:
    """The state of one recording: last values, sums, and where the lap at hand began.

    A lap ends at the moving time of its button, so its first sample may be
    one that came up to the length of all pauses before; samples of that last
    stretch are kept until then.
    """

    samples: int = 0
    t: float = 0.0
    paused: float = 0.0
    speed: float = 0.0
    distance: float = 0.0
    heartrate: float = 0.0
    power: float = 0.0
    cadence: float = 0.0
    altitude: float = 0.0
    gain: float = 0.0
    last_altitude: float | None = None
    hr_sum: float = 0.0
    hr_n: int = 0
    laps: int = 0
    lap_end: float = 0.0
    lap_from: float | None = 0.0
    sport_type: str | None = None
    weight_kg: float | None = None
    recent_t: list[float] = field(default_factory=list)
    recent_d: list[float] = field(default_factory=list)

    def add(self, kind: str, t: float, paused: float | None, speed, distance, altitude, heartrate, power, cadence, sport, weight) -> None:
        self.paused = max(self.paused, _number(paused) or 0.0)
        self.sport_type, self.weight_kg = sport if sport is not None else self.sport_type, _number(weight) or self.weight_kg
        if kind == "lap":
            self.laps, self.lap_end = self.laps + 1, t - self.paused
            self.lap_from = next((d for at, d in zip(self.recent_t, self.recent_d) if at >= self.lap_end), None)
            return
        if kind == "indoor":
            if self.samples and t <= self.t:
                return
            speed, distance, altitude = 0.0, self.distance, 0.0
        self.samples, self.t = self.samples + 1, t
        self.speed, self.distance = _number(speed) or 0.0, _number(distance) or 0.0
        self.heartrate, self.power, self.cadence = (_number(x) or 0.0 for x in (heartrate, power, cadence))
        height = _number(altitude)
        self.altitude = height or 0.0
        if height is not None:
            self.gain += max(0.0, height - self.last_altitude) if self.last_altitude is not None else 0.0
            self.last_altitude = height
        if self.heartrate > 0:
            self.hr_sum, self.hr_n = self.hr_sum + self.heartrate, self.hr_n + 1
        if self.lap_from is None and t >= self.lap_end:
            self.lap_from = self.distance
        self.recent_t.append(t)
        self.recent_d.append(self.distance)
        keep = next((i for i, at in enumerate(self.recent_t) if at >= t - self.paused), 0)
        del self.recent_t[:keep], self.recent_d[:keep]

    def calories(self) -> int:
        weight = self.weight_kg if self.weight_kg is not None else WEIGHT_KG
        if self.hr_n >= HR_SAMPLES:
            a, b, c, d = HR_TERMS
            kcal = max(0.0, (a + b * (self.hr_sum / self.hr_n) + c * weight + d * AGE) / 4.184) * (self.t / 60)
        else:
            kcal = self.t / 3600 * weight * met(self.sport_type)
        return math.floor(kcal + 0.5)

    def figures(self) -> tuple:
        mean = self.distance / self.t if self.t > 0 else 0.0
        pace = lambda v: 1000 / v if v > 0 else 0.0
        lap_time = max(0.0, self.t - math.floor(self.paused) - self.lap_end)
        return (
            self.samples, self.t, self.speed, mean, self.distance, self.heartrate, self.power, self.cadence, self.altitude, self.gain,
            pace(self.speed), pace(mean), self.calories() if self.samples else 0, self.laps, self.distance - (self.lap_from or 0.0), lap_time,
        )

    def pack(self) -> tuple:
        return tuple(getattr(self, c.split()[0]) for c in STATE.split(", "))


NAMES = [c.split()[0] for c in FIGURES.split(", ")]
ROW = ["kind", "t", "paused", "speed", "distance", "altitude", "heartrate", "power", "cadence", "sport_type", "weight_kg"]


def _good(samples: DataFrame) -> DataFrame:
    return samples.filter("recording is not null and t is not null and kind in ('sample', 'indoor', 'lap')")


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    clean = pdf[ROW].astype(object).where(pdf[ROW].notna(), None)
    return clean.itertuples(index=False, name=None)


def live_stream(samples: DataFrame, idle_s: int | None = 6 * 3600) -> DataFrame:
    """The figures of each recording after each micro-batch that had rows of it (update mode).

    State goes after an idle time; with None it stays, and a query over what
    is there now (availableNow) ends, which one with timeouts does not.

    samples: SAMPLES; of a micro-batch, a recording's rows count in order of t
    and seq. The state has a fixed size but for the samples of the last pauses.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = Live(*state.get) if state.exists else Live()
        live.recent_t, live.recent_d = list(live.recent_t), list(live.recent_d)
        live.last_altitude, live.lap_from, live.weight_kg = (_number(x) for x in (live.last_altitude, live.lap_from, live.weight_kg))
        for row in _rows(pd.concat(list(frames)).sort_values(["t", "seq"])):
            live.add(*row)
        state.update(live.pack())
        if idle_s is not None:
            state.setTimeoutDuration(idle_s * 1000)
        yield pd.DataFrame([(key[0], *live.figures())], columns=NAMES)

    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return _good(samples).groupBy("recording").applyInPandasWithState(run, FIGURES, STATE, "update", timeout)


def live_batch(samples: DataFrame) -> DataFrame:
    """The last figures of stored recordings: the same fold, streaming through sorted partitions, one state at a time.

    Rows are dealt by a hash of their recording, not by the recording itself:
    a union whose sides are dealt by it already would be taken as it is, and
    its sides may be cut differently.
    """
    kinds = {"long": pa.int64(), "double": pa.float64()}
    types = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in FIGURES.split(", "))])

    def run(batches):
        key, live = None, None
        for batch in batches:
            out = []
            for k, part in batch.to_pandas().groupby("recording", sort=False):
                if k != key:
                    if live is not None:
                        out.append((key, *live.figures()))
                    key, live = k, Live()
                for row in _rows(part):
                    live.add(*row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
        if live is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, *live.figures()), types)], schema=types)

    return _good(samples).repartition(F.xxhash64("recording")).sortWithinPartitions("recording", "t", "seq").mapInArrow(run, FIGURES)


def indoor_rows(times: DataFrame, sensors: DataFrame, fresh_s: float) -> DataFrame:
    """Time-only samples: at each time (recording, seq, t) the latest value of each sensor, 0 once it is older than fresh_s.

    sensors: recording, t, kind (heartrate, power or cadence), value; values
    that are negative or not finite are none.
    """
    known = sensors.filter((F.col("value") >= 0) & (F.col("value") < float("inf")))
    both = times.select("recording", "t", "seq", F.lit(None).cast("string").alias("sensor"), F.lit(None).cast("double").alias("value")).unionByName(
        known.select("recording", "t", F.lit(None).cast("long").alias("seq"), F.col("kind").alias("sensor"), "value")
    )
    upto = Window.partitionBy("recording").orderBy("t", F.asc_nulls_first("seq")).rowsBetween(Window.unboundedPreceding, 0)

    def held(kind: str):
        mine = F.when(F.col("sensor") == kind, F.struct("t", "value"))
        last = F.last(mine, ignorenulls=True).over(upto)
        return F.when(F.col("t") - last["t"] <= fresh_s, last["value"]).otherwise(0.0).alias(kind)

    return both.select("recording", "seq", "t", F.lit("indoor").alias("kind"), *(held(k) for k in ("heartrate", "power", "cadence"))).filter("seq is not null")
