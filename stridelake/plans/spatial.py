"""Spatial queries; their SQL is brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.operators import sections as sec
from stridelake.operators import spatial as op
from stridelake.plans.registry import query
from stridelake.sources.adapters import visible


def hav(a, b):
    return f"2 * 6371000.0::double * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2), 1.0)))"


PAIRS = f""", mp as (select a.section_id, b.section_id other_id, round({hav('a', 'b')}, 3) metres from sections a join sections b on a.section_id < b.section_id and a.sport_type <> b.sport_type
    where (greatest(a.section_meters, b.section_meters) - least(a.section_meters, b.section_meters)) / greatest(a.section_meters, b.section_meters) <= 0.25 and {hav('a', 'b')} <= 200)"""


@query("p3_viewport", "select activity_id from activities where min_lat <= 46.4 and max_lat >= 46.3 and min_lng <= 7.5 and max_lng >= 7.4")
def viewport(t):
    return t.activities.filter(op.in_viewport(46.3, 46.4, 7.4, 7.5)).select("activity_id")


@query("j14_merge_pairs", PAIRS + " select * from mp")
def merge_pairs(t):
    return op.merge_pairs(t.sections)


@query("j15_o3_nearby_sections", f"""select a.section_id, b.section_id other_id, round({hav('a', 'b')}, 3) metres, (row_number() over (partition by a.section_id order by {hav('a', 'b')}, b.section_id))::int rank
    from sections a join sections b on a.section_id <> b.section_id where {hav('a', 'b')} <= 1500 qualify rank <= 20""")
def nearby(t):
    return op.nearby(t.sections, 1500.0)


@query("j16_overlap_fraction", f""", ca as (select *, floor(lat * 2000)::bigint y, floor(lng * 1000)::bigint x from section_points), cb as (select * replace (y + i as y, x + j as x) from ca, (values (-1), (0), (1)) u(i), (values (-1), (0), (1)) v(j)),
    h as (select a.section_id, b.section_id other_id, count(distinct a.point) hits from ca a join cb b on a.y = b.y and a.x = b.x and a.section_id <> b.section_id where {hav('a', 'b')} <= 50 group by 1, 2)
    select h.section_id, other_id, round(hits / n, 9) fraction from h join (select section_id, count(*) n from section_points group by 1) s on s.section_id = h.section_id""")
def overlap(t):
    """Every two sections whose polylines come within 50 m of each other. (The SQL's cells of 1/2000 by 1/1000 degree are larger than that where the sections are.)"""
    return op.overlaps(t.section_points, 50.0)


@query("j17_merge_candidates", f""", c as (select a.section_id, b.section_id other_id, {hav('a', 'b')} metres from sections a join sections b on a.section_id <> b.section_id
      where not (a.disabled or b.disabled or a.superseded_by is not null or b.superseded_by is not null) and {hav('a', 'b')} <= 300 and abs(a.section_meters - b.section_meters) / greatest(a.section_meters, b.section_meters) <= 0.3),
    h as (select section_id, other_id, count(*) hits from (select distinct c.section_id, c.other_id, a.point from c join section_points a on a.section_id = c.section_id join section_points b on b.section_id = c.other_id where {hav('a', 'b')} <= 50) group by 1, 2),
    f as (select h.section_id, other_id, round(hits / n, 9) fraction from h join (select section_id, count(*) n from section_points group by 1) s on s.section_id = h.section_id),
    n as (select section_id, count(*) laps from traversals where not excluded group by 1)
    select f.section_id, f.other_id, round(metres, 3) metres, fraction, coalesce(laps, 0) laps, (row_number() over (partition by f.section_id order by fraction desc, metres, f.other_id))::int rank
    from f join c on c.section_id = f.section_id and c.other_id = f.other_id left join n on n.section_id = f.other_id where fraction >= 0.3 qualify rank <= 10""")
def candidates(t):
    p = op.merge_candidates(t.sections.filter(visible()), t.section_points)
    n = sec.visit_counts(t.traversals).select(F.col("section_id").alias("other_id"), "laps")
    return p.join(n, "other_id", "left").select("section_id", "other_id", "metres", "fraction", F.coalesce("laps", F.lit(0)).alias("laps"), "rank")


@query("g13_cross_sport_merge", PAIRS + """, e as (select section_id a, other_id b from mp union select other_id, section_id from mp), walk(node, reach) as (select a, a from e union select walk.node, e.b from walk join e on walk.reach = e.a),
    r as (select node, min(reach) root from walk group by 1), n as (select section_id, count(*) laps from traversals where not excluded group by 1), c as (select node, root, coalesce(laps, 0) laps from r left join n on node = section_id)
    select node section_id, first_value(node) over (partition by root order by laps desc, node) kept, count(*) over (partition by root) size from c""")
def merge(t):
    return op.merge_components(t.sections, sec.visit_counts(t.traversals))


@query("g9_g10_portions", f""", p as (select track_id, row_number() over (partition by track_id order by t, point_id) seq, lat, lng from points),
    n as (select distinct p.track_id, l.section_id line_id, seq from p join section_points l on abs(p.lat - l.lat) < 0.001 where {hav('p', 'l')} <= 100), s as (select *, case when seq - lag(seq) over (partition by track_id, line_id order by seq) <= 2 then 0 else 1 end s from n),
    r as (select *, sum(s) over (partition by track_id, line_id order by seq rows unbounded preceding) run from s)
    select track_id, line_id, run::bigint run, min(seq)::int first, max(seq)::int last, count(*) points from r group by 1, 2, 3""")
def portions(t):
    """Portions of every track on every section's polyline."""
    p = t.points.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id"))).select("track_id", "seq", "lat", "lng")
    return op.portions(p, t.section_points, 100.0, 1, least=1)


@query("g27_box_clusters", """, c as (select floor((min_lat + max_lat) / 2 / 0.002)::bigint y, floor((min_lng + max_lng) / 2 / 0.002)::bigint x, count(*) n from activities group by 1, 2),
    e as (select a.y * 100000 + a.x a, b.y * 100000 + b.x b from c a join c b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1), walk(node, reach) as (select a, a from e union select walk.node, e.b from walk join e on walk.reach = e.a),
    r as (select node, min(reach) root from walk group by 1) select sum(n)::bigint activities, count(*) cells from c join r on node = y * 100000 + x group by root""")
def clusters(t):
    return op.box_clusters(t.activities, 0.002).select("activities", "cells")
