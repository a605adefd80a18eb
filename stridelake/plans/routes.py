"""Route queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import routes as op
from stridelake.plans.registry import query

MEMBERS = ", mem as (select route_id, activity_id, date, moving_time, distance, case when direction in ('reverse', 'backward') then 'reverse' else 'forward' end side, case when distance > 0 and moving_time > 0 then distance / moving_time else 0 end speed from metrics)"


@query("a17_w11_route_performances", MEMBERS + """ select *, (row_number() over (partition by route_id order by moving_time, date, activity_id))::int rank,
    min(case when moving_time > 0 then moving_time end) over (partition by route_id) best_time from mem""".replace("select *", "select route_id, activity_id, date, moving_time, distance, side, round(speed, 9) speed"))
def performances(t):
    return op.performances(op.members(t.metrics)).withColumn("speed", F.round("speed", 9))


@query("a17_a35_route_statistics", MEMBERS + """ select route_id, side, count(*) members, min(moving_time) best_time, arg_min(activity_id, struct_pack(a := moving_time, b := date, c := activity_id)) best_activity,
    round(avg(case when speed > 0 then speed end), 9) avg_speed, round(avg(distance), 7) avg_distance, max(date) last_date from mem group by 1, 2""")
def statistics(t):
    return op.statistics(op.members(t.metrics))


@query("a18_excluded_route_performances", MEMBERS + " select route_id, count(*) members, max(date) last_date from mem where activity_id in (select activity_id from metrics where avg_hr > 170) group by 1")
def excluded(t):
    return op.members(t.metrics.filter("avg_hr > 170")).groupBy("route_id").agg(F.count(F.lit(1)).alias("members"), F.max("date").alias("last_date"))


@query("w4_w6_route_highlights", MEMBERS + """, r as (select *, avg(speed) over (partition by route_id, side order by date, activity_id rows between unbounded preceding and 1 preceding) mean,
        row_number() over (partition by route_id, side order by moving_time, date, activity_id) k from mem where moving_time > 0),
    b as (select *, max(case when k = 1 then moving_time end) over p best, max(case when k = 2 then moving_time end) over p sec from r window p as (partition by route_id, side))
    select route_id, side, activity_id, case when mean is null then 0 when speed > 1.01::double * mean then 1 when speed < 0.99::double * mean then -1 else 0 end trend, moving_time = best is_pr, moving_time - best delta,
        case when moving_time = best and sec > moving_time then sec - moving_time end improvement from b""")
def highlights(t):
    return op.highlights(op.members(t.metrics))


@query("a26_group_summaries", "select route_id, count(*) activities, string_agg(distinct sport_type, ',' order by sport_type) sports, min(activity_id) representative from metrics group by 1 having count(*) >= 2")
def summaries(t):
    return op.summaries(t.metrics)


@query("o4_route_page", """, g as (select route_id, count(*) activities, min(activity_id) representative from metrics group by 1 having count(*) >= 2)
    select route_id, activities, representative from g order by activities desc, route_id limit 20 offset 20""")
def page(t):
    return op.summaries(t.metrics).select("route_id", "activities", "representative").orderBy(F.desc("activities"), "route_id").offset(20).limit(20)
