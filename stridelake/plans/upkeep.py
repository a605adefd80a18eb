"""Queries of matching, ingest, incremental grouping and small look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators import detection, spatial, upkeep as op
from stridelake.plans.detection import CFG, GROUPS, SEQ, STEPS, seq
from stridelake.plans.registry import query
from stridelake.plans.spatial import hav


def spans_sql(threshold: float, least: float, then: str = " select * from best", every: bool = False) -> str:
    """SQL of the best stretches of tracks on sections, or of all of them, as CTE `best`, and what follows it."""
    return STEPS + f""", nr as (select distinct sq.track_id, l.section_id, seq, point from sq join section_points l on abs(sq.lat - l.lat) < {threshold} / 100000.0 where {hav('sq', 'l')} <= {threshold}),
    nb as (select *, case when seq - lag(seq) over (partition by track_id, section_id order by seq) <= 2 then 0 else 1 end s from (select distinct track_id, section_id, seq from nr)),
    rn as (select track_id, section_id, seq, sum(s) over (partition by track_id, section_id order by seq rows unbounded preceding) run from nb),
    sp as (select track_id, section_id, run, min(seq) f, max(seq) l, count(distinct point) covered, arg_min(point, seq * 100000 + point) <= arg_max(point, seq * 100000 + point) same from rn join nr using (track_id, section_id, seq) group by 1, 2, 3),
    q as (select sp.*, round(covered / n, 9) quality from sp join (select section_id, count(*) n from section_points group by 1) z using (section_id)),
    best as (select track_id, section_id, f::int as "first", l::int as "last", quality, case when same then 'same' else 'reverse' end direction from q where quality >= {least} qualify {every} or row_number() over (partition by track_id, section_id order by quality desc, f) = 1){then}"""


@query("g12_rematched", spans_sql(125.0, 0.4))
def rematched(t):
    """Every track against every section with the relaxed thresholds: 2.5 times 50 m, 0.4 of the polyline."""
    return op.best_spans(seq(t), t.section_points, 125.0, 0.4)


@query("g21_custom_matches", spans_sql(50.0, 0.8))
def custom(t):
    return op.best_spans(seq(t), t.section_points, 50.0, 0.8)


@query("g2_t8_grouped_with_new", GROUPS + " select * from grp")
def grouped(t):
    """Tracks that began in the first half of the period are grouped, then the later ones come in."""
    p = seq(t)
    first = t.points.groupBy("track_id").agg(F.min("t").alias("t"))
    middle = first.agg(F.median("t").alias("m"))
    old = p.join(first.join(F.broadcast(middle), F.col("t") <= F.col("m")).select("track_id"), "track_id", "left_semi")
    return op.grouped_with_new(p, detection.route_groups(old, CFG), CFG)


@query("s15_ingested", STEPS + """, e as (select track_id, arg_min(lat, seq) start_lat, arg_min(lng, seq) start_lng, arg_max(lat, seq) end_lat, arg_max(lng, seq) end_lng, min(lat) min_lat, max(lat) max_lat, min(lng) min_lng, max(lng) max_lng, round(sum(step), 3) metres, count(*) fixes from st group by 1)
    select * from e""")
def ingested(t):
    return op.ingested(seq(t))


@query("s16_zone_columns", "select activity_id, " + ", ".join([f"moving_time * {i + 1} / 28.0::double power_z{i + 1}" for i in range(7)]) + ", " + ", ".join([f"case when avg_hr > 150 then 0 else {'moving_time * %d / 6.0::double' % (i + 1) if i < 3 else 0} end::double hr_z{i + 1}" for i in range(5)]) + " from metrics")
def zones(t):
    """Power zones from seven values; heart-rate zones from three, or from no array."""
    m = F.col("moving_time")
    power = F.to_json(F.array(*(m * (i + 1) / 28.0 for i in range(7))))
    hr = F.when(F.col("avg_hr") <= 150, F.to_json(F.array(*(m * (i + 1) / 6.0 for i in range(3)))))
    return t.metrics.select("activity_id", power.alias("p"), hr.alias("h")).select("activity_id", *op.zone_columns(F.col("p"), F.col("h")))


@query("f20_season_bests", """, ef as (select m.sport_type, t.distance_meters meters, t.lap_time s, activity_id from traversals t join metrics m using (activity_id) where lap_time > 0 and distance_meters > 0),
    cv as (select sport_type, meters, min(s) best, arg_min(activity_id, struct_pack(s := s, a := activity_id)) activity_id from ef group by 1, 2),
    cp(sport_type, checkpoint) as (values ('Run', 400.0::double), ('Run', 1000), ('Run', 5000), ('Run', 10000), ('Run', 21097.5), ('Swim', 100), ('Swim', 200), ('Swim', 400), ('Swim', 1500))
    select sport_type, checkpoint, meters, round(meters / best, 6) speed, activity_id from cv join cp using (sport_type) qualify row_number() over (partition by sport_type, checkpoint order by abs(meters - checkpoint), meters) = 1""")
def season_bests(t):
    e = t.traversals.join(t.metrics.select("activity_id", "sport_type"), "activity_id").select("sport_type", F.col("distance_meters").alias("meters"), F.col("lap_time").alias("seconds"), "activity_id")
    return op.season_bests(e)


@query("f25_tile_counts", """, b as (select activity_id, min_lat - 5 / 111.0 a, max_lat + 5 / 111.0 b, min_lng - 5 / (111.0 * cos(radians((min_lat + max_lat) / 2))) c, max_lng + 5 / (111.0 * cos(radians((min_lat + max_lat) / 2))) d from activities),
    z as (select *, unnest(range(1, 13)) z from b)
    select activity_id, sum((floor((d + 180) / 360 * pow(2, z)) - floor((c + 180) / 360 * pow(2, z)) + 1) * (floor((1 - ln(tan(radians(a)) + 1 / cos(radians(a))) / pi()) / 2 * pow(2, z)) - floor((1 - ln(tan(radians(b)) + 1 / cos(radians(b))) / pi()) / 2 * pow(2, z)) + 1))::bigint tiles from z group by 1""")
def tile_counts(t):
    """Tiles at zooms 1 to 12 of each activity's box, widened by 5 km."""
    a, b, c, d = S.expanded_bounds(F.col("min_lat"), F.col("max_lat"), F.col("min_lng"), F.col("max_lng"), 5.0)
    box = t.activities.select("activity_id", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return box.select("activity_id", S.tile_count(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 1, 12).alias("tiles"))


@query("p6_sections_by_type", """, n as (select section_id, count(*) laps from traversals where not excluded group by 1)
    select section_id, section_type, name, sport_type, section_meters, disabled, superseded_by, lat, lng, coalesce(laps, 0) laps from sections left join n using (section_id) where section_type = 'custom'""")
def by_type(t):
    n = t.traversals.filter(~F.col("excluded")).groupBy("section_id").agg(F.count(F.lit(1)).alias("laps"))
    return t.sections.filter("section_type = 'custom'").join(n, "section_id", "left").withColumn("laps", F.coalesce("laps", F.lit(0)))


@query("o4_page_with_more", """, g as (select route_id, count(*) activities, min(activity_id) representative from metrics group by 1 having count(*) >= 2), k as (select *, row_number() over (order by activities desc, route_id) k, count(*) over () total from g)
    select route_id, activities, representative, total > 40 has_more, total from k where k between 21 and 40""")
def page(t):
    """The second page of twenty groups, and whether there is a third; one row past the page is read."""
    g = t.metrics.groupBy("route_id").agg(F.count(F.lit(1)).alias("activities"), F.min("activity_id").alias("representative")).filter("activities >= 2")
    some = g.orderBy(F.desc("activities"), "route_id").offset(20).limit(21)
    w = Window.orderBy(F.desc("activities"), "route_id")  # twenty-one rows
    rows = some.withColumn("k", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > 20).filter("k <= 20")
    total = g.agg(F.count(F.lit(1)).alias("total"))
    return rows.join(F.broadcast(total)).select("route_id", "activities", "representative", "has_more", "total")


@query("o4_nearest_page", f""", g as (select route_id, count(*) activities, min(min_lat) a, max(max_lat) b, min(min_lng) c, max(max_lng) d from metrics join activities using (activity_id) group by 1 having count(*) >= 2),
    m as (select route_id, activities, {hav("p", "q")} metres from (select *, 46.4::double ulat, 7.3::double ulng, (a + b) / 2 la, (c + d) / 2 lo from g) z, lateral (select z.ulat lat, z.ulng lng) p, lateral (select z.la lat, z.lo lng) q),
    k as (select *, row_number() over (order by metres, activities desc, route_id) k, count(*) over () total from m) select route_id, activities, round(metres, 3) metres, total > 30 has_more from k where k between 21 and 30""")
def nearest_page(t):
    """The third page of ten groups, nearest to a position first."""
    g = t.metrics.select("activity_id", "route_id").join(t.activities.drop("name"), "activity_id").groupBy("route_id").agg(
        F.count(F.lit(1)).alias("activities"), *(f(c).alias(c) for c, f in (("min_lat", F.min), ("max_lat", F.max), ("min_lng", F.min), ("max_lng", F.max)))
    ).filter("activities >= 2")
    page = spatial.nearest_first(g, 46.4, 7.3, 10, 20, [F.desc("activities"), "route_id"])
    return page.select("route_id", "activities", F.round("metres", 3).alias("metres"), "has_more")


@query("t6_live_figures", STEPS + """, r as (select track_id, t, value - lag(value) over (partition by track_id order by t, point_id) rise from points), g as (select track_id, (max(t) - min(t))::bigint s, sum(greatest(coalesce(rise, 0), 0)) climbed from r group by 1),
    m as (select track_id, count(*) fixes, sum(step) m from st group by 1) select track_id, fixes, s elapsed, round(m, 3) metres, round(case when s > 0 then m / s else 0 end, 6) speed, round(climbed, 3) climbed from m join g using (track_id)""")
def live(t):
    p = t.points.select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id")).alias("seq"), "t", "lat", "lng", F.col("value").alias("elevation"))
    return op.metres_between(p)
