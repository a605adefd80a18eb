"""Queries of scans, filters, joins, upserts, exports and recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators import sections as sec
from stridelake.plans.registry import query
from stridelake.plans.spatial import hav
from stridelake.sources import tables as op
from stridelake.streaming import recording


@query("s1_scan_activities", "select * from activities")
def scan(t):
    return t.activities


@query("s2_s4_metrics_for_ids", "select activity_id, date, moving_time, distance from metrics where activity_id in (select activity_id from traversals where excluded)")
def for_ids(t):
    """Metrics of the activities of a list: all that have an excluded lap."""
    ids = t.traversals.filter("excluded").select("activity_id").distinct()
    return t.metrics.select("activity_id", "date", "moving_time", "distance").join(ids, "activity_id", "left_semi")


@query("s3_lookup", "select activity_id, name, sport_type from activities where activity_id = 7")
def lookup(t):
    return t.activities.filter("activity_id = 7").select("activity_id", "name", "sport_type")


@query("s5_signatures", "select track_id, count(*) points, round((min(lat) + max(lat)) / 2, 7) lat, round((min(lng) + max(lng)) / 2, 7) lng from points group by 1")
def signatures(t):
    return t.points.groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), F.round((F.min("lat") + F.max("lat")) / 2, 7).alias("lat"), F.round((F.min("lng") + F.max("lng")) / 2, 7).alias("lng"))


def tracks(t):
    """Recordings as arrays: the fixes of a user on one day, so their number is bounded by its seconds."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("t", "point_id", "lat", "lng", "value"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), p["value"].alias("elevation")))
    return t.points.groupBy("track_id", F.floor(F.col("t") / 86400).alias("day")).agg(pts.alias("track"))


@query("s6_s14_valid_tracks", "select track_id, t // 86400 as day, count(*)::int points from points where lat between -90 and 90 and lng between -180 and 180 group by 1, 2 having count(*) >= 2")
def valid(t):
    return tracks(t).withColumn("track", op.valid_track(F.col("track"))).filter("track is not null").select("track_id", "day", F.size("track").alias("points"))


@query("s8_stream_parse", "select track_id, t // 86400 as day, count(*)::int points, round(min(value), 4) low from points group by 1, 2")
def streams(t):
    """Streams written as JSON and parsed back."""
    s = tracks(t).select("track_id", "day", F.to_json(F.array(
        F.struct(F.lit("latlng").alias("type"), F.transform("track", lambda p: p["lat"]).alias("data"), F.transform("track", lambda p: p["lng"]).alias("data2")),
        F.struct(F.lit("fixed_altitude").alias("type"), F.transform("track", lambda p: p["elevation"]).alias("data"), F.array().cast("array<double>").alias("data2")),
    )).alias("j")).withColumn("s", op.parse_streams(F.col("j")))
    return s.select("track_id", "day", F.size("s.track").alias("points"), F.round(F.array_min("s.altitude"), 4).alias("low"))


@query("s9_s10_curves", "select activity_id, round(max(distance_meters / lap_time), 6) best_speed, count(*)::int points, max(distance_meters)::double longest from traversals where lap_time > 0 group by 1")
def curves(t):
    """Pace curves as JSON, one of each activity's laps, and parsed back."""
    g = t.traversals.filter("lap_time > 0").groupBy("activity_id").agg(F.collect_list(F.struct("distance_meters", "lap_time")).alias("laps"))
    j = F.to_json(F.struct(F.array(F.struct(F.col("laps.distance_meters").alias("distance"), F.col("laps.lap_time").alias("values"))).alias("list")))
    c = g.select("activity_id", op.parse_pace_curve(j).alias("c"))
    return c.select("activity_id", F.round(F.array_max("c.speed"), 6).alias("best_speed"), F.size("c.speed").alias("points"), F.array_max("c.distance").alias("longest"))


@query("s11_s28_engine_stats", "select count(*) activities, min(start_date) first_date, max(start_date) last_date, count(distinct sport_type) sports from activities")
def stats(t):
    return t.activities.agg(F.count(F.lit(1)).alias("activities"), F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"), F.countDistinct("sport_type").alias("sports"))


@query("s13_slices", "select track_id, t // 86400 as day, (count(*) // 2)::int first_half, (count(*) - count(*) // 2)::int second_half from points group by 1, 2")
def slices(t):
    n = F.size("track")
    return tracks(t).select("track_id", "day", op.slices(F.col("track"), F.array(F.lit(0), F.floor(n / 2).cast("int"), n)).alias("s")).select("track_id", "day", F.size(F.get("s", 0)).alias("first_half"), F.size(F.get("s", 1)).alias("second_half"))


@query("s16_s19_upsert", "select activity_id, case when sport_type = 'Run' then moving_time + 60 else moving_time end moving_time, date from metrics")
def upsert(t):
    m = t.metrics.select("activity_id", "moving_time", "date")
    new = t.metrics.filter("sport_type = 'Run'").select("activity_id", "moving_time", "date").withColumn("moving_time", F.col("moving_time") + 60)
    return op.upsert(m, op.unchanged(new, m, "activity_id", ["date", "moving_time"]), ["activity_id"], ["date"])


@query("s21_cascade_delete", "select section_id, count(*) laps from traversals where activity_id not in (select activity_id from activities where sport_type = 'Swim') group by 1")
def delete(t):
    return op.without(t.traversals, t.activities.filter("sport_type = 'Swim'"), "activity_id").groupBy("section_id").agg(F.count(F.lit(1)).alias("laps"))


@query("s22_retention", "select activity_id from metrics where date >= 996624000 - 365 * 86400")
def retention(t):
    return op.retained(t.metrics, "date", 996624000, 365).select("activity_id")


def exported(t):
    return tracks(t).select(F.col("track_id").alias("activity_id"), "day", F.col("track").alias("points")).join(t.metrics.select("activity_id", "name", "sport_type"), "activity_id", "left")


@query("s23_j9_gpx", """, g as (select track_id activity_id, t // 86400 as day, string_agg('<trkpt lat="' || lat::varchar || '" lon="' || lng::varchar || '"></trkpt>', '' order by t, point_id) p from points group by 1, 2)
    select activity_id, day, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>' || coalesce(name, '') || '</name><type>' || coalesce(sport_type, '') || '</type><trkseg>' || p || '</trkseg></trk></gpx>' gpx from g left join metrics using (activity_id)""")
def gpx(t):
    return op.gpx(exported(t))


@query("s24_geojson", """, g as (select track_id activity_id, t // 86400 as day, string_agg('[' || lng::varchar || ',' || lat::varchar || ']', ',' order by t, point_id) p from points group by 1, 2)
    select activity_id, day, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || p || ']},"properties":{"id":' || activity_id::varchar || coalesce(',"name":"' || name || '"', '') || coalesce(',"sport":"' || sport_type || '"', '') || '}}' feature from g left join metrics using (activity_id)""")
def geojson(t):
    return op.geojson(exported(t))


@query("s27_coordinate_codec", "select track_id, t // 86400 as day, count(*)::int points, true same from points group by 1, 2")
def codec(t):
    r = tracks(t).withColumn("lat", F.transform("track", lambda p: p["lat"])).withColumn("back", op.decode_coordinates(op.encode_coordinates(F.col("lat"))))
    gap = F.array_max(F.zip_with("lat", "back", lambda a, b: F.abs(a - b)))
    return r.select("track_id", "day", F.size("back").alias("points"), (gap < 1e-6).alias("same"))


@query("f_simplified_tracks")
def simplified(t):
    r = tracks(t).select("track_id", "day", F.transform("track", lambda p: p["lat"]).alias("lat"), F.transform("track", lambda p: p["lng"]).alias("lng"))
    return r.select("track_id", "day", F.size("lat").alias("points"), op.simplified("lat", "lng", F.lit(100.0)).alias("kept"))


@query("p1_date_range", "select activity_id from metrics where date between 820454400 and 852076800")
def date_range(t):
    return t.metrics.filter(F.col("date").between(820454400, 852076800)).select("activity_id")


@query("p2_map_filter", "select activity_id, coalesce(name, '') as name from activities where (start_date is null or start_date between 820454400 and 852076800) and sport_type in ('Ride', 'Run')")
def map_filter(t):
    s = F.col("start_date")
    return t.activities.filter((s.isNull() | s.between(820454400, 852076800)) & F.col("sport_type").isin("Ride", "Run")).select("activity_id", F.coalesce("name", F.lit("")).alias("name"))


@query("p4_ids_by_sport", "select activity_id from activities where sport_type = 'Run'")
def by_sport(t):
    return t.activities.filter("sport_type = 'Run'").select("activity_id")


@query("p11_direction_class", "select section_id, case when direction in ('reverse', 'backward') then 'reverse' else 'forward' end side, count(*) laps from traversals group by 1, 2")
def direction(t):
    return t.traversals.groupBy("section_id", S.direction_class(F.col("direction")).alias("side")).agg(F.count(F.lit(1)).alias("laps"))


@query("p12_plausible", "select section_id, activity_id, start_index from traversals where lap_time * 1000 / distance_meters between 60 and 1800 and distance_meters > 0")
def plausible(t):
    return t.traversals.filter((F.col("distance_meters") > 0) & (F.col("lap_time") * 1000 / F.col("distance_meters")).between(60, 1800)).select("section_id", "activity_id", "start_index")


@query("p14_exclusion_overlay", "select section_id, activity_id, start_index, case when avg_hr > 119 then true else excluded end excluded from traversals")
def overlay(t):
    o = t.traversals.filter("avg_hr > 119").select("section_id", "activity_id", "start_index", F.lit(True).alias("set_to"))
    return t.traversals.join(o, ["section_id", "activity_id", "start_index"], "left").select("section_id", "activity_id", "start_index", F.coalesce("set_to", "excluded").alias("excluded"))


@query("j1_j4_joined_laps", "select t.section_id, t.activity_id, t.start_index, s.name, m.date, a.start_date from traversals t join sections s using (section_id) join metrics m using (activity_id) join activities a using (activity_id) where not excluded and not disabled")
def joined(t):
    s = t.sections.filter(~F.col("disabled")).select("section_id", "name")
    return t.traversals.filter(~F.col("excluded")).join(s, "section_id").join(t.metrics.select("activity_id", "date"), "activity_id").join(t.activities.select("activity_id", "start_date"), "activity_id").select("section_id", "activity_id", "start_index", "name", "date", "start_date")


@query("j2_sport_performances", "select section_id, count(*) laps, min(lap_time) best from traversals join metrics using (activity_id) where sport_type = 'Run' and not excluded group by 1")
def sport(t):
    return t.traversals.filter(~F.col("excluded")).join(t.metrics.filter("sport_type = 'Run'").select("activity_id"), "activity_id").groupBy("section_id").agg(F.count(F.lit(1)).alias("laps"), F.min("lap_time").alias("best"))


@query("j5_j6_encounters", "select section_id, activity_id, coalesce(max(start_date), 0) date, count(*) laps from traversals left join activities using (activity_id) group by 1, 2")
def encounters(t):
    return t.traversals.join(t.activities.select("activity_id", "start_date"), "activity_id", "left").groupBy("section_id", "activity_id").agg(F.coalesce(F.max("start_date"), F.lit(0)).alias("date"), F.count(F.lit(1)).alias("laps"))


@query("j12_backfill_duration", "select activity_id, coalesce(nullif(duration_secs, 0), m.moving_time) duration from activities left join metrics m using (activity_id)")
def backfill(t):
    return t.activities.select("activity_id", "duration_secs").join(t.metrics.select("activity_id", "moving_time"), "activity_id", "left").select("activity_id", F.coalesce(F.nullif("duration_secs", F.lit(0)), "moving_time").alias("duration"))


@query("j13_visit_count_per_section", "select section_id, (select count(*) from traversals t where t.section_id = s.section_id and not excluded) visit_count from sections s")
def visit_count(t):
    n = t.traversals.filter(~F.col("excluded")).groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return t.sections.join(n, "section_id", "left").select("section_id", F.coalesce("n", F.lit(0)).alias("visit_count"))


@query("j18_route_of_activity", "select t.section_id, m.route_id, count(*) laps from traversals t join metrics m using (activity_id) group by 1, 2")
def route_of(t):
    return t.traversals.join(t.metrics.select("activity_id", "route_id"), "activity_id").groupBy("section_id", "route_id").agg(F.count(F.lit(1)).alias("laps"))


@query("g37_lap_time_backfill", """, st as (select track_id activity_id, list(t order by t, point_id) ts from points group by 1)
    select section_id, activity_id, start_index, round(coalesce(lap_time, abs(ts[start_index + 6] - ts[start_index + 1])), 3) lap_time from traversals left join st using (activity_id) where not excluded""")
def lap_backfill(t):
    """Times at a lap's first and last fix, joined by their position in the track."""
    at = t.points.select(F.col("track_id").alias("activity_id"), "t", (F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id")) - 1).alias("i"))
    rows = t.traversals.filter(~F.col("excluded")).withColumn("end_index", F.col("start_index") + 5)
    rows = rows.join(at.toDF("activity_id", "t0", "start_index"), ["activity_id", "start_index"], "left").join(at.toDF("activity_id", "t1", "end_index"), ["activity_id", "end_index"], "left")
    lap = F.coalesce("lap_time", F.abs(F.col("t1") - F.col("t0")).cast("double"))
    return rows.select("section_id", "activity_id", "start_index", F.round(lap, 3).alias("lap_time"))


@query("g37_null_laps_backfilled", """, st as (select track_id activity_id, list(t order by t, point_id) ts from points group by 1),
    r as (select section_id, activity_id, start_index, distance_meters, abs(ts[start_index + start_index % 4 * 2 - 1] - ts[start_index + 1])::double lap_time from traversals join st using (activity_id) where lap_time is null and start_index > 0 and start_index % 4 * 2 - 2 > 0)
    select section_id, activity_id, start_index, lap_time, round(distance_meters / lap_time, 6) lap_pace from r where lap_time > 0""")
def null_laps(t):
    """Stretches of up to four fixes that end 2 * (start mod 4) - 2 fixes after their start; where that is not later, they are skipped."""
    at = t.points.select(F.col("track_id").alias("activity_id"), "t", (F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id")) - 1).alias("index"))
    return sec.backfilled_laps(t.traversals.withColumn("end_index", F.col("start_index") + F.col("start_index") % 4 * 2 - 2), at)


@query("t1_t2_cleaned_recording", f""", q as (select track_id, t, lat, lng, row_number() over (partition by track_id order by point_id) k from points where point_id % 40 <= 30),
    w as (select track_id, 0::bigint k, null::bigint t, null::double lat, null::double lng, 0::double total_m, 0::double step_m, false kept from (select distinct track_id from q) union all
      select a.track_id, a.k, case when a.good then a.t else a.wt end, case when a.good then a.lat else a.wlat end, case when a.good then a.lng else a.wlng end, case when a.good then a.total_m + coalesce(a.step, 0) else a.total_m end, coalesce(a.step, 0), a.good
      from (select z.*, wt is null or (t > wt and step / (t - wt) <= 35) good from (select y.*, case when wt is not null then {hav("r", "p")} end step from
        (select q.*, w.t wt, w.lat wlat, w.lng wlng, w.total_m from w join q on q.track_id = w.track_id and q.k = w.k + 1) y, lateral (select y.lat lat, y.lng lng) p, lateral (select y.wlat lat, y.wlng lng) r) z) a)
    select track_id, t, round(lat, 6) lat, round(lng, 6) lng, round(step_m, 4) step_m, round(total_m, 4) total_m from w where kept""")
def cleaned(t):
    """Fixes with an accuracy of 0 to 39 m, without the inaccurate ones and without jumps."""
    p = t.points.select("track_id", "t", "lat", "lng", F.lit("Ride").alias("sport_type"), "point_id", (F.col("point_id") % 40).alias("accuracy"))
    rows = recording.cleaned_batch(recording.accurate(p))
    return rows.select("track_id", "t", *(F.round(c, n).alias(c) for c, n in (("lat", 6), ("lng", 6), ("step_m", 4), ("total_m", 4))))


@query("t3_sample_and_hold", """, s as (select track_id, t, point_id, value, last_value(case when point_id % 3 = 0 then value end ignore nulls) over w v, last_value(case when point_id % 3 = 0 then t end ignore nulls) over w as_of from points window w as (partition by track_id order by t, point_id rows unbounded preceding))
    select track_id, point_id, case when t - as_of <= 86400 then v else 0 end held from s""")
def held(t):
    return recording.sample_and_hold(t.points, F.col("point_id") % 3 == 0, "value", 86400)


@query("t5_auto_pause", """, q as (select track_id, t, value v, row_number() over (partition by track_id order by t, point_id) k from points),
    w as (select track_id, 0::bigint k, null::bigint t, false paused, null::bigint since, null::varchar as "event" from (select distinct track_id from points) union all
      select q.track_id, q.k, q.t, case when paused then v < 50 else v < 40 and q.t - coalesce(since, q.t) >= 5 end, case when paused then case when v < 50 then since end when v < 40 then coalesce(since, q.t) end,
        case when paused and v >= 50 then 'resume' when not paused and v < 40 and q.t - coalesce(since, q.t) >= 5 then 'pause' end from w join q on q.track_id = w.track_id and q.k = w.k + 1)
    select track_id, t, "event" from w where "event" is not null""")
def paused(t):
    return recording.auto_pause(t.points, "value", 40.0, 5)


@query("t6_live_metrics", "select track_id, count(*) points, (max(t) - min(t))::bigint elapsed, max(value) top from points group by 1")
def live(t):
    return recording.live_metrics(t.points)
