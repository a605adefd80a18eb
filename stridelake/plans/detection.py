"""Grouping, detection and section-upkeep queries, composites and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.operators import detection as op
from stridelake.operators import fitness, routes, spatial
from stridelake.operators import sections as sec
from stridelake.operators.graph import ensure_checkpoint_dir
from stridelake.plans.registry import query
from stridelake.plans.sections import EFFICIENCY, INDICATORS, LAPS, NOW, RANKED, laps
from stridelake.plans.spatial import hav
from stridelake.sources import fit, tables

CFG = op.DetectionConfig(endpoint_m=2500.0, length_ratio=0.7)
SEQ = ", sq as (select track_id, row_number() over (partition by track_id order by t, point_id) seq, lat, lng from points)"
STEPS = SEQ + f""", pr as (select *, lag(lat) over w pl, lag(lng) over w pg from sq window w as (partition by track_id order by seq)), st as (select track_id, seq, a.lat, a.lng, case when b.lat is null then 0 else {hav('a', 'b')} end step from (select * from pr) q, lateral (select q.lat lat, q.lng lng) a, lateral (select q.pl lat, q.pg lng) b)"""


def seq(t):
    return t.points.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id"))).select("track_id", "seq", "lat", "lng")


GROUPS = STEPS + f""", sg as (select track_id, arg_min(lat, seq) lat, arg_min(lng, seq) lng, arg_max(lat, seq) el, arg_max(lng, seq) eg, sum(step) len from st group by 1),
    e as (select a.track_id x, b.track_id y from sg a join sg b on a.track_id < b.track_id where {hav('a', 'b')} <= 2500 and least(a.len, b.len) / greatest(a.len, b.len) >= 0.7
      and 2 * 6371000.0::double * asin(sqrt(least(pow(sin(radians(b.el - a.el) / 2), 2) + cos(radians(a.el)) * cos(radians(b.el)) * pow(sin(radians(b.eg - a.eg) / 2), 2), 1.0))) <= 2500),
    u as (select x, y from e union select y, x from e), walk(node, reach) as (select track_id, track_id from sg union select walk.node, u.y from walk join u on walk.reach = u.x),
    grp as (select node track_id, min(reach) route from walk group by 1)"""


@query("g1_g2_route_groups", GROUPS + " select * from grp")
def groups(t):
    return op.route_groups(seq(t), CFG)


ONE_WAY = "least(coalesce(min(" + hav("p", "q") + "), 500), 500)"


@query("g3_g4_match_percent", GROUPS + f""", mem as (select track_id, route from grp where track_id <> route),
    x as (select track_id, avg(d) ab from (select m.track_id, m.seq, {ONE_WAY.replace("p.", "m.").replace("q.", "r.")} d from (select mem.*, seq, lat, lng from mem join sq using (track_id)) m join sq r on r.track_id = m.route group by 1, 2) group by 1),
    y as (select track_id, avg(d) ba from (select m.track_id, r.seq, {ONE_WAY.replace("p.", "r.").replace("q.", "m.")} d from (select mem.*, seq, lat, lng from mem join sq using (track_id)) m join sq r on r.track_id = m.route group by 1, 2) group by 1)
    select track_id pair, round((ab + ba) / 2, 3) amd, round(greatest(least((500 - (ab + ba) / 2) / 490 * 100, 100), 0), 3) as match from x join y using (track_id)""")
def match(t):
    """Each member of a route against its representative, the route's first track."""
    p = seq(t)
    return routes.match_percent(p, op.route_groups(p, CFG).filter("track_id <> route"), 10.0, 500.0)


@query("g5_route_medoid", GROUPS + f""", nn as (select track_id, route, count(*) n from grp join sq using (track_id) group by 1, 2),
    pp as (select a.route route_id, a.track_id a, b.track_id b, least(20, a.n, b.n) k, a.n na, b.n nb from nn a join nn b on a.route = b.route and a.track_id <> b.track_id),
    dd as (select pp.route_id, pp.a, pp.b, p.seq, min({hav("p", "q")}) d from pp join sq p on p.track_id = pp.a and (p.seq - 1) % (na // k) = 0 and (p.seq - 1) / (na // k) < k join sq q on q.track_id = pp.b and (q.seq - 1) % (nb // k) = 0 and (q.seq - 1) / (nb // k) < k group by 1, 2, 3, 4),
    s as (select route_id, a, round(sum(d), 3) s from (select route_id, a, b, avg(d) d from dd group by 1, 2, 3) group by 1, 2) select route_id, arg_min(a, struct_pack(s := s, a := a)) medoid, min(s) total from s group by 1""")
def medoid(t):
    """Of each route of two tracks or more, by distances of sampled points."""
    p = seq(t)
    return routes.route_medoids(p, op.route_groups(p, CFG).select("track_id", F.col("route").alias("route_id")))


@query("g6_detected_sections", """, c as (select floor(lat / 0.002)::bigint y, floor(lng / 0.002)::bigint x, count(distinct track_id) tracks from points group by 1, 2 having count(distinct track_id) >= 3),
    e as (select a.y * 1000000 + a.x a, b.y * 1000000 + b.x b from c a join c b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1), walk(node, reach) as (select a, a from e union select walk.node, e.b from walk join e on walk.reach = e.a),
    r as (select node, min(reach) root from walk group by 1) select count(*) cells, max(tracks) peak, sum(tracks)::bigint passes from c join r on node = y * 1000000 + x group by root having count(*) >= 2""")
def detected(t):
    return op.detected_sections(t.points, CFG).select("cells", "peak", "passes")


@query("g20_consensus", "select floor(lat / 0.002)::bigint y, floor(lng / 0.002)::bigint x, round(avg(lat), 9) lat, round(avg(lng), 9) lng, count(distinct track_id) tracks from points group by 1, 2")
def consensus(t):
    return op.consensus(t.points, 0.002)


@query("g28_potential_sections", "select floor(lat / 0.002)::bigint y, floor(lng / 0.002)::bigint x, count(distinct track_id) tracks from points group by 1, 2 having count(distinct track_id) >= 3")
def potential(t):
    return op.busy_cells(t.points, CFG)


@query("g8_box_candidates", "select activity_id from activities where min_lat <= 46.4 + 100 / 111194.9 and max_lat >= 46.3 - 100 / 111194.9 and min_lng <= 7.5 + 100 / 111194.9 / cos(radians(46.4 + 100 / 111194.9)) and max_lng >= 7.4 - 100 / 111194.9 / cos(radians(46.4 + 100 / 111194.9))")
def boxes(t):
    return op.candidates_by_box(t.activities, 46.3, 46.4, 7.4, 7.5, 50.0).select("activity_id")


COUNTS = ", n as (select section_id, count(*) laps from traversals where not excluded group by 1)"


@query("g15_pruned_sections", COUNTS + f""", s as (select section_id, sport_type, coalesce(laps, 0) laps from sections left join n using (section_id) where section_type = 'auto'),
    sp as (select s.*, point, lat, lng, count(*) over (partition by section_id) size from s join section_points using (section_id)),
    c as (select a.section_id, a.size, count(distinct a.point) hits from sp a join sp b on a.sport_type = b.sport_type and a.section_id <> b.section_id and abs(a.lat - b.lat) < 0.0005 and (b.laps > a.laps or (b.laps = a.laps and b.section_id < a.section_id))
      where {hav('a', 'b')} <= 50 group by a.section_id, a.size, b.section_id)
    select section_id, sport_type, laps from s where section_id not in (select section_id from c where round(hits / size, 9) >= 0.5)""")
def pruned(t):
    return op.pruned(t.sections, t.section_points, sec.visit_counts(t.traversals), 50.0, 0.5)


@query("g14_merged_traversals", """, m as (select t.*, coalesce(superseded_by, section_id) p, (superseded_by is not null)::int mv from traversals t join sections using (section_id)),
    k as (select p section_id, activity_id, start_index, distance_meters, row_number() over (partition by p, activity_id, start_index order by mv, distance_meters, lap_time nulls first) k from m)
    select section_id, activity_id, start_index, distance_meters from k where k = 1""")
def merged(t):
    moves = t.sections.filter("superseded_by is not null").select(F.col("section_id").alias("secondary"), F.col("superseded_by").alias("primary"))
    return op.merged_traversals(t.traversals, moves).select("section_id", "activity_id", "start_index", "distance_meters")


@query("g16_numbered_names", """, tk as (select distinct sport_type, regexp_extract(name, '^\\S+ Section (\\d+)$', 1)::bigint n from sections where regexp_matches(name, '^\\S+ Section \\d+$')),
    b as (select section_id, sport_type, row_number() over (partition by sport_type order by section_id) k from sections where name is null),
    f as (select s.sport_type, g.n, row_number() over (partition by s.sport_type order by g.n) k from (select distinct sport_type from b) s, range(1, 100000) g(n) where (s.sport_type, g.n) not in (select (sport_type, n) from tk))
    select section_id, b.sport_type || ' Section ' || n::varchar as name from b join f on b.sport_type = f.sport_type and b.k = f.k""")
def names(t):
    return op.numbered_names(t.sections)


@query("g17_trimmed", STEPS + ", b as (select track_id, count(*) // 10 + 1 f, count(*) - count(*) // 10 l from points group by 1) select track_id, count(*) points, round(sum(case when seq > f then step else 0 end), 3) metres from st join b using (track_id) where seq between f and l group by 1")
def trimmed(t):
    """Each track without its first and last tenth."""
    b = t.points.groupBy("track_id").agg(F.expr("count(1) div 10 + 1").alias("first"), F.expr("count(1) - count(1) div 10").alias("last"))
    return op.trimmed(seq(t), b)


@query("g18_section_edits", "select section_id, case when name is null then 'Renamed ' || section_id::varchar else name end as name, case when section_meters > 4000 then true else disabled end disabled, superseded_by from sections")
def edits(t):
    s = t.sections
    e = s.filter("name is null").select("section_id", F.concat(F.lit("Renamed "), F.col("section_id").cast("string")).alias("name"), F.lit(None).cast("boolean").alias("disabled"), F.lit(2).alias("at"))
    e = e.unionByName(s.filter("name is null").select("section_id", F.lit("Old").alias("name"), F.lit(None).cast("boolean").alias("disabled"), F.lit(1).alias("at")))
    e = e.unionByName(s.filter("section_meters > 4000").select("section_id", F.lit(None).cast("string").alias("name"), F.lit(True).alias("disabled"), F.lit(3).alias("at")))
    return op.edited(t.sections, e.withColumn("superseded_by", F.lit(None).cast("long")))


@query("g11_g19_traces", SEQ + f" select distinct sq.track_id, l.section_id line_id, seq::int seq, sq.lat, sq.lng from sq join section_points l on abs(sq.lat - l.lat) < 0.002 where {hav('sq', 'l')} <= 200")
def traces(t):
    """Fixes of every track near every section's polyline."""
    return spatial.traces(seq(t), t.section_points, 200.0)


@query("t7_refreshed_indicators", INDICATORS + " select * from ind")
def refreshed(t):
    """Indicators after new traversals: sections that they touch are computed anew, the rest is kept."""
    new = F.col("date") >= NOW - 30 * 86400
    ensure_checkpoint_dir(t.spark)
    # Read three times, so made once.
    rows = sec.timed(t.traversals, t.sections, t.activities).select("section_id", "direction", "activity_id", "start_index", "date", "time").checkpoint()
    old = sec.indicators(rows.filter(~new))
    touched = rows.filter(new).select("section_id").distinct()
    return old.join(touched, "section_id", "left_anti").unionByName(sec.indicators(rows.join(touched, "section_id", "left_semi"))).select("activity_id", "kind", "section_id", "direction", "value", "lap_time")


@query("g36_summary_card", f""", p as (select count(*) n, coalesce(sum(moving_time), 0)::bigint moving_time, round(coalesce(sum(training_load), 0), 3) load from metrics where date between {NOW} - 604800 and {NOW}),
    w as (select round(coalesce(ctl, 0))::bigint fitness, round(coalesce(ctl, 0) - coalesce(atl, 0))::bigint form from wellness order by date desc limit 1), f as (select ftp from metrics where ftp is not null and sport_type = 'Ride' order by date desc, activity_id desc limit 1)
    select n, moving_time, load, fitness, form, ftp from p, w, f""")
def card(t):
    """One row of figures, joined from one-row aggregates."""
    p = fitness.period_stats(t.metrics, NOW - 604800, NOW).select(F.col("count").alias("n"), "moving_time", F.col("training_load").alias("load"))
    w = fitness.heart_series(t.wellness, 1).select("fitness", "form")
    f = fitness.threshold_change(t.metrics, "ftp", fitness.FTP_SPORTS).select(F.col("latest").alias("ftp"))
    return p.join(w).join(f)


@query("i4_record_insights", RANKED + " select section_id, best, traversals from ranked where latest_is_pr and traversals >= 3 order by relevance desc, section_id limit 3")
def record_insights(t):
    return sec.ranked(laps(t), NOW).filter("latest_is_pr and traversals >= 3").orderBy(F.desc("relevance"), "section_id").limit(3).select("section_id", "best", "traversals")


@query("i5_trend_insights", RANKED + " select section_id, trend, latest_is_pr, traversals from ranked where traversals >= 3 and trend <> 0 and days_since_last <= 28 order by trend desc, latest_is_pr desc, traversals desc, section_id limit 2")
def trend_insights(t):
    return sec.ranked(laps(t), NOW).filter("traversals >= 3 and trend <> 0 and days_since_last <= 28").orderBy(F.desc("trend"), F.desc("latest_is_pr"), F.desc("traversals"), "section_id").limit(2).select("section_id", "trend", "latest_is_pr", "traversals")


@query("i6_efficiency_insights", EFFICIENCY + " select * from eff where improving and effort_count >= 3 and abs(hr_change) >= 1 order by hr_change, section_id limit 3")
def efficiency_insights(t):
    hr = t.traversals.select("section_id", "activity_id", "start_index", F.col("avg_hr").alias("lap_hr"))
    return sec.efficiency_trend(laps(t), hr).filter("improving and effort_count >= 3 and abs(hr_change) >= 1").orderBy("hr_change", "section_id").limit(3)


@query("i7_fitness_milestone", """, r as (select *, row_number() over (order by date desc, activity_id desc) n from metrics where ftp is not null and sport_type = 'Ride' qualify n <= 20), l as (select ftp latest from r where n = 1), b as (select latest, (select ftp from r where ftp <> latest order by n limit 1) previous from l)
    select latest, previous, latest - previous gain, latest - previous >= 5 milestone from b""")
def milestone(t):
    c = fitness.threshold_change(t.metrics, "ftp", fitness.FTP_SPORTS)
    return c.select("latest", "previous", (F.col("latest") - F.col("previous")).alias("gain"), (F.col("latest") - F.col("previous") >= 5).alias("milestone"))


@query("i7_pace_milestone", "".join(f", c{sport} as (select *, row_number() over (order by date desc, activity_id desc) n from (select *, round(distance / moving_time, 6) cs from metrics where moving_time > 0 and sport_type = '{sport}') qualify n <= 20)" for sport in ("Run", "Swim")) + " " + " union all ".join(f"""select '{sport}' sport, latest, previous, floor({m} / previous - {m} / latest + 0.5)::bigint gain_secs, floor((latest - previous) / previous * 100 + 0.5)::bigint gain_percent from
      (select (select cs from c{sport} where n = 1) latest, (select cs from c{sport} where abs(cs - (select cs from c{sport} where n = 1)) > 0.02 order by n limit 1) previous) where latest > previous and gain_secs > 0 and gain_percent > 0""" for sport, m in (("Run", 1000), ("Swim", 100))))
def pace_milestone(t):
    """Runs by the kilometre, swims by 100 m."""
    m = t.metrics.filter("moving_time > 0").withColumn("cs", F.round(F.col("distance") / F.col("moving_time"), 6))
    out = [fitness.pace_milestone(fitness.threshold_change(m, "cs", [s], gap=0.02), metres).select(F.lit(s).alias("sport"), "latest", "previous", F.col("gain_secs").cast("long").alias("gain_secs"), F.col("gain_percent").cast("long").alias("gain_percent")) for s, metres in (("Run", 1000), ("Swim", 100))]
    return out[0].unionByName(out[1])


@query("i8_hrv_insight", """, v as (select list(hrv order by date) v, count(*) n from (select * from wellness order by date desc limit 28) where hrv > 0) select n::int points, round(least(1, n / 7.0::double), 6) confidence from v where n >= 5""")
def hrv_insight(t):
    return fitness.hrv_trend(t.wellness, 28).select("points", F.round(F.least(F.lit(1.0), F.col("points") / 7.0), 6).alias("confidence"))


@query("i19_normalised_series", """select track_id, point_id, round(case when max(value) over w > min(value) over w then (value - min(value) over w) / (max(value) over w - min(value) over w) else 0.5 end, 9)::double share from points window w as (partition by track_id)""")
def normalised(t):
    w = Window.partitionBy("track_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return t.points.select("track_id", "point_id", F.round(F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.5), 9).alias("share"))


@query("s12_fit_round_trip", "select activity_id, (row_number() over (partition by activity_id order by set_order) - 1)::int set_order, exercise_category, set_type, repetitions, floor(weight_kg * 16 + 0.5) / 16 weight_kg from exercise_sets")
def fit_files(t):
    s = F.array_sort(F.collect_list(F.struct("set_order", "exercise_category", "set_type", "repetitions", "weight_kg")))
    files = t.exercise_sets.groupBy("activity_id").agg(s.alias("sets")).select("activity_id", fit.encode_sets("sets").alias("content"))
    return fit.parse_files(files).drop("duration_secs")


@query("s17_wellness_upsert", "select date, case when hrv is null then 1.5 else ctl end ctl from wellness")
def wellness_upsert(t):
    w = t.wellness.select("date", "ctl")
    new = t.wellness.filter("hrv is null").select("date", F.lit(1.5).alias("ctl"))
    return tables.upsert(w, new.withColumn("ctl", tables.finite(F.col("ctl"))), ["date"], ["ctl"])


@query("s18_pace_snapshots", "select strftime(make_timestamp(date * 1000000), '%Y-%m-%d') as day, sport_type, max(round(distance / moving_time, 6)) critical_speed from metrics where moving_time > 0 group by 1, 2")
def snapshots(t):
    """Snapshots by day and sport, the fastest replacing the others."""
    m = t.metrics.filter("moving_time > 0").select(F.date_format(F.timestamp_seconds("date"), "yyyy-MM-dd").alias("day"), "sport_type", F.round(F.col("distance") / F.col("moving_time"), 6).alias("critical_speed"))
    return tables.upsert(m.limit(0), m, ["day", "sport_type"], ["critical_speed"])


@query("s20_settings", "select o_orderpriority as key, max(o_clerk) as value from (select o_orderpriority, o_orderstatus o_clerk from orders) group by 1")
def settings(t):
    """Key-value settings with the last write of each key."""
    kv = t.raw("orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value"))
    return tables.upsert(kv.limit(0), kv, ["key"], ["value"])
