"""Keeping tables current: matching tracks to sections anew, grouping new tracks, ingest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalar import haversine
from stridelake.operators.detection import DetectionConfig, grouped, signatures, step_lengths, with_routes
from stridelake.operators.spatial import line_kinds, near_lines

#: Share of new tracks from which all are grouped anew.
FULL_FROM = 0.9


def spans(points: DataFrame, polylines: DataFrame, threshold_m: float, least: float, max_gap: int = 1) -> DataFrame:
    """Stretches of tracks that cover at least the share `least` of a section's polyline.

    points: track_id, seq, lat, lng; polylines: section_id, point, lat, lng.
    A stretch is a run of fixes within the threshold, over gaps of max_gap
    fixes. Its direction is that in which it passes the polyline's points.
    Sections of equal polylines share their stretches.
    """
    lines, members = line_kinds(polylines)
    return _of_sections(_kind_spans(points, lines, threshold_m, least, max_gap), members)


def _of_sections(found: DataFrame, members: DataFrame) -> DataFrame:
    return found.join(members.hint("merge"), "kind").select("track_id", "section_id", "first", "last", "quality", "direction")


def _kind_spans(points: DataFrame, lines: DataFrame, threshold_m: float, least: float, max_gap: int) -> DataFrame:
    """Stretches on unlike polylines (kind, point, lat, lng)."""
    near = near_lines(points.select("track_id", "seq", "lat", "lng"), lines, threshold_m).select("track_id", "kind", "seq", "point")
    w = Window.partitionBy("track_id", "kind").orderBy("seq")
    starts = near.withColumn("s", (F.coalesce(F.col("seq") - F.lag("seq").over(w), F.lit(10**9)) > max_gap + 1).cast("int"))
    runs = starts.withColumn("run", F.sum("s").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    sizes = lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    at = lambda agg, order: agg(F.struct(order, "point"))["point"]
    found = runs.groupBy("track_id", "kind", "run").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("point").alias("covered"), (at(F.min, "seq") <= at(F.max, "seq")).alias("same"),
    )
    found = found.join(sizes.hint("merge"), "kind").withColumn("quality", F.round(F.col("covered") / F.col("n"), 9)).filter(F.col("quality") >= least)
    return found.select("track_id", "kind", "first", "last", "quality", F.when(F.col("same"), "same").otherwise("reverse").alias("direction"))


def best_spans(points: DataFrame, polylines: DataFrame, threshold_m: float, least: float, max_gap: int = 1) -> DataFrame:
    """Of each track and section the stretch that covers most of the polyline (ties: the earlier one).

    Standard matching takes the proximity and half of the polyline; a rematch
    2.5 times the proximity and 0.4 of it; a custom section 50 m and 0.8.
    """
    best = F.max_by(F.struct("first", "last", "quality", "direction"), F.struct("quality", (-F.col("first")).alias("f")))
    lines, members = line_kinds(polylines)
    found = _kind_spans(points, lines, threshold_m, least, max_gap).groupBy("track_id", "kind").agg(best.alias("b")).select("track_id", "kind", "b.*")
    return _of_sections(found, members)


def grouped_with_new(points: DataFrame, groups: DataFrame, cfg: DetectionConfig, full_from: float = FULL_FROM) -> DataFrame:
    """track_id and route after new tracks came in: as route_groups gives them over all tracks. See regrouped."""
    return regrouped(signatures(points), groups, cfg, full_from)


def regrouped(sigs: DataFrame, groups: DataFrame, cfg: DetectionConfig, full_from: float = FULL_FROM) -> DataFrame:
    """track_id and route of all tracks with a signature.

    groups: track_id and route of the tracks grouped before. Old groups stay
    valid: an old track stands for its group through one edge, and only tracks
    of different groups are compared. Where at least full_from of the tracks
    are new, all are grouped anew. Two counts reach the driver.
    """
    old = groups.select("track_id", "route")
    new = sigs.join(old, "track_id", "left_anti")
    total, fresh = sigs.count(), new.count()
    if fresh >= full_from * total:
        return grouped(sigs, cfg)
    return with_routes(sigs, cfg, old.filter("track_id <> route").select(F.col("track_id").alias("a"), F.col("route").alias("b")))


def ingested(points: DataFrame) -> DataFrame:
    """The row that is stored with each track: its box (0 where it has no fix), ends, length and number of fixes."""
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    box = points.groupBy("track_id").agg(*(F.coalesce(f(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("min", F.min), ("max", F.max))))
    first, last = F.min(F.struct("seq", "lat", "lng")), F.max(F.struct("seq", "lat", "lng"))
    sig = step_lengths(points.filter(ok)).groupBy("track_id").agg(
        first["lat"].alias("start_lat"), first["lng"].alias("start_lng"), last["lat"].alias("end_lat"), last["lng"].alias("end_lng"), F.round(F.sum("step"), 3).alias("metres"), F.count(F.lit(1)).alias("fixes")
    )
    return box.join(sig, "track_id", "left").fillna(0, ["metres", "fixes"])


def zone_columns(power_json: Column, hr_json: Column) -> list[Column]:
    """Seconds in the seven power and five heart-rate zones from JSON arrays; 0 for what is missing or no array."""

    def zones(c: Column, n: int, name: str) -> list[Column]:
        values = F.from_json(c, "array<double>")
        return [F.coalesce(F.get(values, i), F.lit(0.0)).alias(f"{name}_z{i + 1}") for i in range(n)]

    return zones(power_json, 7, "power") + zones(hr_json, 5, "hr")


# Metres for which a season's best is shown, by sport.
CHECKPOINTS = {"Run": [400.0, 1000.0, 5000.0, 10000.0, 21097.5], "Swim": [100.0, 200.0, 400.0, 1500.0]}


def season_bests(efforts: DataFrame) -> DataFrame:
    """Of each sport's pace curve, the speed at the distance nearest to each checkpoint (ties: the shorter one).

    efforts: sport_type, meters, seconds, activity_id. The curve has the
    fastest effort of each distance (ties: the smallest activity_id).
    """
    ok = efforts.filter("meters > 0 and seconds > 0")
    best = F.min(F.struct("seconds", "activity_id"))
    curve = ok.groupBy("sport_type", "meters").agg(best["seconds"].alias("seconds"), best["activity_id"].alias("activity_id"))
    marks = F.create_map(*(x for k, v in CHECKPOINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    at = curve.withColumn("checkpoint", F.explode(F.element_at(marks, F.col("sport_type"))))
    nearest = F.min(F.struct(F.abs(F.col("meters") - F.col("checkpoint")).alias("gap"), "meters", "seconds", "activity_id"))
    return at.groupBy("sport_type", "checkpoint").agg(nearest.alias("n")).select(
        "sport_type", "checkpoint", "n.meters", F.round(F.col("n.meters") / F.col("n.seconds"), 6).alias("speed"), F.col("n.activity_id").alias("activity_id")
    )


def metres_between(points: DataFrame) -> DataFrame:
    """Live figures of each recording (track_id, seq, t, lat, lng, elevation): fixes, seconds, metres, mean speed and metres climbed."""
    w = Window.partitionBy("track_id").orderBy("seq")
    step = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0))
    rise = F.greatest(F.coalesce(F.col("elevation") - F.lag("elevation").over(w), F.lit(0.0)), F.lit(0.0))
    g = points.withColumn("step", step).withColumn("rise", rise).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("fixes"), (F.max("t") - F.min("t")).alias("elapsed"), F.sum("step").alias("m"), F.round(F.sum("rise"), 3).alias("climbed")
    )
    return g.select("track_id", "fixes", "elapsed", F.round("m", 3).alias("metres"), F.round(F.when(F.col("elapsed") > 0, F.col("m") / F.col("elapsed")).otherwise(0.0), 6).alias("speed"), "climbed")
