"""Scalar functions of the domain as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0

# Names of exercise categories 0 to 32.
EXERCISES = [
    "Bench Press", "Calf Raise", "Cardio", "Carry", "Chop", "Core", "Crunch", "Curl", "Deadlift", "Flye", "Hip Raise",
    "Hip Stability", "Hip Swing", "Hyperextension", "Lateral Raise", "Leg Curl", "Leg Raise", "Lunge", "Olympic Lift", "Plank", "Plyo", "Pull Up",
    "Push Up", "Row", "Shoulder Press", "Shoulder Stability", "Shrug", "Sit Up", "Squat", "Total Body", "Triceps Extension", "Warm Up", "Run",
]

# Fixed values: (primary, secondary) muscles of exercise categories 0 to 32.
MUSCLES = [
    ("chest triceps", "deltoids"), ("calves", ""), ("", ""), ("forearm trapezius", "abs obliques"), ("obliques abs", "deltoids"), ("abs obliques", "lower-back"),
    ("abs", "obliques"), ("biceps", "forearm"), ("hamstring gluteal lower-back", "trapezius forearm"), ("chest", "deltoids"), ("gluteal", "hamstring"),
    ("gluteal", "adductors"), ("gluteal hamstring", "abs"), ("lower-back", "gluteal hamstring"), ("deltoids", "trapezius"), ("hamstring", "calves"),
    ("abs", "obliques"), ("quadriceps gluteal", "hamstring calves"), ("quadriceps gluteal trapezius", "deltoids hamstring"), ("abs obliques", "lower-back"),
    ("quadriceps calves", "hamstring gluteal"), ("upper-back biceps", "forearm deltoids"), ("chest triceps", "deltoids abs"), ("upper-back biceps", "lower-back forearm"),
    ("deltoids triceps", "trapezius"), ("deltoids", "trapezius"), ("trapezius", ""), ("abs", "obliques"), ("quadriceps gluteal", "hamstring calves lower-back"),
    ("quadriceps chest deltoids", "abs triceps"), ("triceps", ""), ("", ""), ("", ""),
]


def muscle_rows() -> list[tuple[int, str, int]]:
    """(category, muscle, intensity): 2 for primary muscles, 1 for secondary ones."""
    return [(c, m, k) for c, pair in enumerate(MUSCLES) for k, names in zip((2, 1), pair) for m in names.split()]


def round_half_up(c: Column) -> Column:
    """Rounding where halves go up, also below zero."""
    return F.floor(c + 0.5)


def epoch_date(c: Column) -> Column:
    return F.to_date(F.timestamp_seconds(c))


def calendar_days_between(a: Column, b: Column) -> Column:
    """Days from a's UTC date to b's, at least 0."""
    return F.greatest(F.floor(b / 86400) - F.floor(a / 86400), F.lit(0)).cast("long")


def elapsed_days(a: Column, b: Column) -> Column:
    return F.greatest(F.floor((b - a) / 86400), F.lit(0)).cast("long")


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of radius EARTH_M; null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def speed(distance: Column, time: Column) -> Column:
    """Metres a second; 0 where either is not positive."""
    return F.when((distance > 0) & (time > 0), distance / time).otherwise(0.0)


def pace_per_km(distance: Column, time: Column) -> Column:
    """Seconds a kilometre; 0 where either is not positive."""
    return F.when((distance > 0) & (time > 0), time * 1000 / distance).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is a positive number (variability index, efficiency factor)."""
    return F.when((b > 0) & ~F.isnan(b), a / b)


def form_zone(tsb: Column) -> Column:
    return F.when(tsb < -30, "highRisk").when(tsb < -10, "optimal").when(tsb < 5, "greyZone").when(tsb < 25, "fresh").otherwise("transition")


def direction_class(c: Column) -> Column:
    return F.when(c.isin("reverse", "backward"), "reverse").otherwise("forward")


def trend_label(c: Column) -> Column:
    return F.when(c > 0, "improving").when(c < 0, "declining").otherwise("stable")


def exercise_name(category: Column) -> Column:
    known = F.try_element_at(F.array(*map(F.lit, EXERCISES)), category + 1)
    named = F.when(category.between(0, len(EXERCISES) - 1), known).otherwise(F.concat(F.lit("Exercise "), category.cast("string")))
    return F.when(category.isin(65534, 65535), "Unknown Exercise").otherwise(named)


def sport_category(sport: Column) -> Column:
    s = F.lower(sport)
    has = lambda *words: s.rlike("|".join(words))
    return F.when(has("ride", "cycling", "bike"), "cycling").when(has("run", "treadmill"), "running").when(has("walk", "hike"), "walking").otherwise("cycling")


def max_plausible_speed(sport: Column) -> Column:
    """Metres a second beyond which a fix is a jump."""
    c = sport_category(sport)
    return F.when(c == "running", 12.5).when(c == "walking", 8.0).otherwise(35.0)


def punitive(text: Column) -> Column:
    """Wording that blames the reader."""
    return text.rlike(r"(?i)\byou (haven't|have not|didn't|did not) ") | text.rlike(r"(?i)\byou (failed|missed) ") | text.rlike(r"(?i)\bbehind schedule\b") | text.rlike(r"(?i)\bnot enough\b")


def auto_named(name: Column) -> Column:
    """Names of the form "{Sport} {word} {number}"."""
    return name.rlike(r"^\S+ \S+ \d+$")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tile_x(lng: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.floor((lng + 180) / 360 * n).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    r = F.radians(F.greatest(F.least(lat, F.lit(85.051129)), F.lit(-85.051129)))
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("long")


def calories(avg_hr: Column, n_hr: Column, seconds: Column, weight_kg: Column, met: Column) -> Column:
    """Heart-rate regression with at least 30 samples, else the metabolic equivalent."""
    by_hr = F.greatest((-55.0969 + 0.6309 * avg_hr + 0.1988 * weight_kg + 0.2017 * 35) / 4.184, F.lit(0.0)) * seconds / 60
    return round_half_up(F.when(n_hr >= 30, by_hr).otherwise(seconds / 3600 * weight_kg * met))


def lap_seconds(times: Column, start: Column, end: Column) -> Column:
    """Seconds between two indices of a time stream; null where either is outside."""
    return F.abs(F.get(times, end) - F.get(times, start))


def nearest_on_curve(xs: Column, ys: Column, target: Column) -> Column:
    """The curve's value at the x nearest to target; the first of equally near ones."""
    gaps = F.transform(xs, lambda x, i: F.struct(F.abs(x - target).alias("gap"), i.alias("i")))
    return F.get(ys, F.array_min(gaps)["i"])


def elevation_gain(values: Column) -> Column:
    """Sum of the rises between consecutive valid values of an array."""
    valid = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    step = F.transform(valid, lambda v, i: F.when(i > 0, F.greatest(v - F.get(valid, i - 1), F.lit(0.0))).otherwise(0.0))
    return F.aggregate(step, F.lit(0.0), lambda a, x: a + x)


def upper_middle(values: Column) -> Column:
    """Element n / 2 of the sorted array: the upper of two middle ones."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def tile_bounds(zoom: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Lowest and highest latitude, then longitude, of a tile."""
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return lat(y + 1), lat(y), x / n * 360 - 180, (x + 1) / n * 360 - 180


def expanded_bounds(min_lat: Column, max_lat: Column, min_lng: Column, max_lng: Column, radius_km: float) -> tuple[Column, Column, Column, Column]:
    """A box widened by a radius: 111 km a degree of latitude, and as many times the cosine of the middle one of longitude."""
    dy = radius_km / 111.0
    middle = F.greatest(F.least((min_lat + max_lat) / 2, F.lit(85.051129)), F.lit(-85.051129))
    dx = radius_km / (111.0 * F.cos(F.radians(middle)))
    return min_lat - dy, max_lat + dy, min_lng - dx, max_lng + dx


def tile_count(min_lat: Column, max_lat: Column, min_lng: Column, max_lng: Column, first: int, last: int) -> Column:
    """Tiles that a box touches at the zooms from first to last."""
    each = [(tile_x(max_lng, z) - tile_x(min_lng, z) + 1) * (tile_y(min_lat, z) - tile_y(max_lat, z) + 1) for z in range(first, last + 1)]
    return sum(each[1:], each[0])


# Days of smoothing for each time range.
SMOOTHING = {"7d": 0, "1m": 3, "42d": 5, "3m": 7, "6m": 14, "1y": 21}


def smoothing_window(preference: str | int, time_range: str) -> int:
    """Days to smooth over: none, the range's own (auto), or as many as asked for."""
    return 0 if preference == "none" else SMOOTHING[time_range] if preference == "auto" else int(preference)
