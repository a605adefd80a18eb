"""Schemas, parsing of JSON drops, upserts, retention, and text exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

from stridelake.functions.scalar import xml_escape

ACTIVITY = "activity_id long, sport_type string, start_date long, name string, distance_meters double, duration_secs long, min_lat double, max_lat double, min_lng double, max_lng double"
TRACK = "activity_id long, track array<struct<lat: double, lng: double, elevation: double>>"
STREAMS = "array<struct<type: string, data: array<double>, data2: array<double>>>"
POWER_CURVES = "struct<list: array<struct<secs: array<int>, values: array<double>>>>"
PACE_CURVES = "struct<list: array<struct<distance: array<double>, values: array<double>, paceModels: array<struct<type: string, criticalSpeed: double, dPrime: double>>>>>"
WELLNESS = "date string, ctl double, atl double, hrv double, resting_hr double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON drops with an explicit schema; malformed rows fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def parse_streams(c: Column) -> Column:
    """Stream JSON to a struct: track (latitudes and longitudes cut to the shorter), altitude (the corrected one first), pace in minutes a kilometre."""
    s = F.from_json(c, STREAMS)
    one = lambda name: F.get(F.filter(s, lambda x: x["type"] == name), 0)
    ll = one("latlng")
    n = F.least(F.size(ll["data"]), F.size(ll["data2"]))
    track = F.when(n > 0, F.arrays_zip(F.slice(ll["data"], 1, n).alias("lat"), F.slice(ll["data2"], 1, n).alias("lng")))
    pace = F.transform(one("ga_velocity")["data"], lambda v: F.when(v > 0, 1000 / v / 60).otherwise(0.0))
    return F.struct(track.alias("track"), F.coalesce(one("fixed_altitude")["data"], one("altitude")["data"]).alias("altitude"), one("time")["data"].alias("time"), pace.alias("pace"))


def parse_power_curve(c: Column) -> Column:
    """The first listed curve: seconds and watts."""
    first = F.get(F.from_json(c, POWER_CURVES)["list"], 0)
    return F.struct(first["secs"].alias("secs"), first["values"].alias("watts"))


def parse_pace_curve(c: Column) -> Column:
    """The first listed curve: distances, times, metres a second (0 for times not above 0), and the critical-speed model."""
    first = F.get(F.from_json(c, PACE_CURVES)["list"], 0)
    pace = F.zip_with(first["distance"], first["values"], lambda d, t: F.when(t > 0, d / t).otherwise(0.0))
    model = F.get(F.filter(first["paceModels"], lambda m: m["type"] == "CS"), 0)
    return F.struct(first["distance"].alias("distance"), first["values"].alias("secs"), pace.alias("speed"), model["criticalSpeed"].alias("critical_speed"), model["dPrime"].alias("d_prime"))


def valid_track(track: Column) -> Column:
    """Points with finite coordinates in range; null for fewer than two."""
    ok = F.filter(track, lambda p: p["lat"].isNotNull() & p["lng"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lng"]) & p["lat"].between(-90, 90) & p["lng"].between(-180, 180))
    return F.when(F.size(ok) >= 2, ok)


def slices(flat: Column, offsets: Column) -> Column:
    """Arrays between consecutive offsets of a flat array; null where offsets do not fit."""
    n = F.size(offsets)
    fits = (F.array_max(offsets) <= F.size(flat)) & (F.array_sort(offsets) == offsets)
    return F.when(fits & (n >= 2), F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.slice(flat, F.get(offsets, i) + 1, F.get(offsets, i + 1) - F.get(offsets, i))))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both, keeping for each key the row that comes last: new before old, then by `order`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def unchanged(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new that differ from old in key or columns: what an upsert has to write."""
    return new.join(old.select(key, *columns), [key, *columns], "left_anti")


def retained(df: DataFrame, created: str, now: int, days: int) -> DataFrame:
    """Rows created in the last days; all for 0."""
    return df if days == 0 else df.filter(F.col(created) >= now - days * 86400)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade of a delete: rows whose key is not among those gone."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def _names(tracks: DataFrame) -> list[str]:
    """The columns that name a track: its activity, and the day if it has one."""
    return [c for c in ("activity_id", "day") if c in tracks.columns]


def gpx(tracks: DataFrame) -> DataFrame:
    """activity_id and a GPX document for each track (name, sport_type, points: array of lat, lng)."""
    pts = F.transform("points", lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lng"].cast("string"), F.lit('"></trkpt>')))
    doc = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), xml_escape(F.coalesce("name", F.lit(""))), F.lit("</name><type>"),
        xml_escape(F.coalesce("sport_type", F.lit(""))), F.lit("</type><trkseg>"), F.concat_ws("", pts), F.lit("</trkseg></trk></gpx>"),
    )
    return tracks.select(*_names(tracks), doc.alias("gpx"))


def geojson(tracks: DataFrame) -> DataFrame:
    """activity_id and a GeoJSON feature for each track."""
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    props = F.struct(F.col("activity_id").alias("id"), F.col("name"), F.col("sport_type").alias("sport"))
    return tracks.select(*_names(tracks), F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("feature"))


@F.pandas_udf(BinaryType())
def encode_coordinates(values: pd.Series) -> pd.Series:
    """Arrays of degrees as differences of units of 1e-7, zig-zag and variable length."""

    def one(xs):
        d = np.diff(np.round(np.asarray(xs, float) * 1e7).astype(np.int64), prepend=0)
        out = bytearray()
        for v in ((d << 1) ^ (d >> 63)).astype(np.uint64).tolist():
            while v >= 128:
                out.append(v & 127 | 128)
                v >>= 7
            out.append(v)
        return bytes(out)

    return values.map(lambda xs: None if xs is None else one(xs))


@F.pandas_udf(ArrayType(DoubleType()))
def decode_coordinates(values: pd.Series) -> pd.Series:
    """The inverse of encode_coordinates, to 1e-7 degrees."""

    def one(data):
        out, last, shift, v = [], 0, 0, 0
        for b in data:
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                last += (v >> 1) ^ -(v & 1)
                out.append(last / 1e7)
                shift = v = 0
        return out

    return values.map(lambda x: None if x is None else one(x))


@F.pandas_udf(ArrayType(StructType().add("lat", "double").add("lng", "double")))
def decode_polyline(values: pd.Series) -> pd.Series:
    """Polylines encoded in printable characters, five bits each, at 1e-5 degrees."""

    def one(text):
        numbers, shift, v = [], 0, 0
        for c in text:
            b = ord(c) - 63
            v |= (b & 31) << shift
            shift += 5
            if b < 32:
                numbers.append(~(v >> 1) if v & 1 else v >> 1)
                shift = v = 0
        pairs = np.cumsum(np.array(numbers, float).reshape(-1, 2), axis=0) / 1e5 if numbers else np.empty((0, 2))
        return [{"lat": a, "lng": b} for a, b in pairs.tolist()]

    return values.map(lambda x: None if x is None else one(x))


@F.pandas_udf(ArrayType(IntegerType()))
def simplified(lats: pd.Series, lngs: pd.Series, tolerance_m: pd.Series) -> pd.Series:
    """Indices that a polyline keeps when points within tolerance metres of the line between kept neighbours go."""

    def one(lat, lng, tol):
        y = np.asarray(lat, float) * 111_194.9
        x = np.asarray(lng, float) * 111_194.9 * np.cos(np.radians(np.mean(lat)))
        keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            length = np.hypot(dx, dy)
            d = np.abs(dx * py - dy * px) / length if length > 0 else np.hypot(px, py)
            k = int(d.argmax())
            if d[k] > tol:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return sorted(keep)

    return pd.Series([None if a is None or not len(a) else one(a, b, t) for a, b, t in zip(lats, lngs, tolerance_m)])
