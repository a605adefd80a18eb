"""Section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import sections as op
from stridelake.plans.registry import query
from stridelake.sources.adapters import visible

NOW = 978307200  # 2001-01-01
LAPS = ", laps as (select t.*, s.section_meters, s.sport_type section_sport, m.date, m.sport_type, m.distance, m.moving_time from traversals t join sections s using (section_id) join metrics m using (activity_id) where not excluded)"
OK = "direction <> 'partial' and (section_meters is null or section_meters <= 0 or distance_meters >= 0.7 * section_meters)"
TIMED = f""", timed as (select * from (select t.section_id, t.activity_id, t.start_index, t.direction, coalesce(a.start_date, 0) date,
    coalesce(lap_time, case when a.distance_meters > 0 and t.distance_meters > 0 then a.duration_secs * (t.distance_meters / a.distance_meters) end) as time
    from traversals t join sections s using (section_id) join activities a using (activity_id) where not excluded and t.direction <> 'partial' and (section_meters <= 0 or t.distance_meters >= 0.7 * section_meters)) where time > 0)"""
INDICATORS = TIMED + """, r as (select *, count(*) over p n, min(time) over p least, avg(time) over (partition by section_id, direction order by date, activity_id, start_index rows between unbounded preceding and 1 preceding) mean from timed window p as (partition by section_id, direction)),
    q as (select *, case when mean is null then 0 when time < 0.98::double * mean then 1 when time > 1.02::double * mean then -1 else 0 end trend, abs(time - least) < 0.001 is_pr from r where n >= 2),
    e as (select *, 'section_pr' kind, 1 as value from q where is_pr union all select *, 'section_trend', trend from q where is_pr or trend <> 0),
    ind as (select activity_id, kind, section_id, direction, value, round(time, 4) lap_time from e qualify row_number() over (partition by activity_id, kind, section_id, direction order by date desc, start_index desc) = 1)"""


def laps(t):
    return op.laps(t.traversals, t.sections, t.metrics)


@query("a7_a12_section_visit_counts", "select section_id, count(*) laps, count(distinct activity_id) activities from traversals where not excluded group by 1")
def visits(t):
    return op.visit_counts(t.traversals)


@query("a8_a9_section_summaries", """, c as (select section_id, count(*) visit_count, string_agg(distinct sport_type, ',' order by sport_type) sports from traversals join metrics using (activity_id) where not excluded group by 1)
    select section_id, name, section_type, section_meters, coalesce(visit_count, 0) visit_count, coalesce(sports, '') sports from sections left join c using (section_id) where not disabled and superseded_by is null""")
def summaries(t):
    return op.summaries(t.sections.filter(visible()), t.traversals, t.metrics)


@query("p5_p7_visible_sections_by_type", "select section_id, name, sport_type from sections where not disabled and superseded_by is null and section_type = 'custom'")
def by_type(t):
    return t.sections.filter(visible() & (F.col("section_type") == "custom")).select("section_id", "name", "sport_type")


@query("p8_o5_sorted_summaries", """, c as (select section_id, count(*) visit_count from traversals where not excluded group by 1), f as (select section_id, coalesce(visit_count, 0) visit_count from sections left join c using (section_id) where not disabled and superseded_by is null)
    select section_id, visit_count, count(*) over () total_count from f order by visit_count desc, section_id limit 50""")
def sorted_summaries(t):
    c = t.traversals.filter(~F.col("excluded")).groupBy("section_id").agg(F.count(F.lit(1)).alias("visit_count"))
    f = t.sections.filter(visible()).join(c, "section_id", "left").select("section_id", F.coalesce("visit_count", F.lit(0)).alias("visit_count"))
    return f.orderBy(F.desc("visit_count"), "section_id").limit(50).join(F.broadcast(f.agg(F.count(F.lit(1)).alias("total_count"))))


@query("a10_pairs_with_two_laps", LAPS + f" select section_id, direction, count(*) laps from laps where {OK} group by 1, 2 having count(*) >= 2")
def pairs(t):
    return laps(t).filter(op.complete()).groupBy("section_id", "direction").agg(F.count(F.lit(1)).alias("laps")).filter("laps >= 2")


@query("p10_effective_time", TIMED + " select section_id, activity_id, start_index, round(time, 4) effective_time from timed")
def effective(t):
    return op.timed(t.traversals, t.sections, t.activities).select("section_id", "activity_id", "start_index", F.round("time", 4).alias("effective_time"))


@query("a14_activity_records", LAPS + f""", b as (select section_id, activity_id, max(struct_pack(p := lap_pace, i := -start_index, t := lap_time)) x from laps where {OK} and lap_pace > 0 group by 1, 2)
    select section_id, activity_id, min(date) date, count(*) lap_count, coalesce(any_value(x.t), 0) best_time, coalesce(any_value(x.p), 0) best_pace, round(avg(lap_time), 7) avg_time, round(avg(lap_pace), 9) avg_pace, arg_min(direction, start_index) direction
    from laps left join b using (section_id, activity_id) group by 1, 2""")
def activity_records(t):
    return op.activity_records(laps(t)).drop("laps")


def _best(name, cond):
    return f"""{name} as (select section_id, lap_time {name}_time, lap_pace {name}_pace, activity_id {name}_activity from laps where {OK} and lap_pace > 0 and {cond}
        qualify row_number() over (partition by section_id order by lap_pace desc, date, activity_id, start_index) = 1)"""


@query("a15_section_records", LAPS + ", l as (select *, direction in ('reverse', 'backward') rev from laps), " + _best("best", "true") + ", " + _best("forward", "direction not in ('reverse', 'backward')") + ", " + _best("reverse", "direction in ('reverse', 'backward')") + """
    , g as (select section_id, round(avg(case when not rev then lap_time end), 7) forward_avg, max(case when not rev then date end) forward_last, count(case when not rev then 1 end) forward_count,
        round(avg(case when rev then lap_time end), 7) reverse_avg, max(case when rev then date end) reverse_last, count(case when rev then 1 end) reverse_count from l group by 1)
    select * from g left join best using (section_id) left join forward using (section_id) left join reverse using (section_id)""")
def section_records(t):
    return op.section_records(laps(t))


@query("a16_excluded_section_records", "select section_id, activity_id, min(date) date, min(lap_time) best_time, count(*) lap_count from traversals join metrics using (activity_id) where excluded group by 1, 2")
def excluded_records(t):
    return op.excluded_records(t.traversals, t.metrics)


@query("p13_excluded_ids", "select distinct section_id, activity_id from traversals where excluded")
def excluded_ids(t):
    return t.traversals.filter("excluded").select("section_id", "activity_id").distinct()


@query("w1_w3_indicators", INDICATORS + " select * from ind")
def indicators(t):
    return op.indicators(op.timed(t.traversals, t.sections, t.activities))


@query("g32_section_highlights", INDICATORS + ", m as (select activity_id, section_id, max(struct_pack(p := (kind = 'section_pr')::int, v := value, d := direction)) x from ind group by 1, 2) select activity_id, section_id, x.p is_pr, x.v trend from m")
def highlights(t):
    return op.highlights(op.indicators(op.timed(t.traversals, t.sections, t.activities)))


@query("w7_encounter_history", LAPS + """, r as (select section_id, direction, activity_id, start_index, lap_time, coalesce(start_date, 0) s from laps left join (select activity_id, start_date from activities) using (activity_id) where lap_time > 0),
    v as (select *, (row_number() over o)::int visit, min(lap_time) over (o rows unbounded preceding) best_so_far, count(*) over w visit_count, min(lap_time) over w best, last_value(lap_time) over (o rows between unbounded preceding and unbounded following) latest
        from r window w as (partition by section_id, direction), o as (partition by section_id, direction order by s, activity_id, start_index))
    select section_id, direction, activity_id, start_index, lap_time, visit, best_so_far, visit_count, best, latest, latest <= best * 1.005::double latest_is_pr from v""")
def history(t):
    return op.lap_history(laps(t), t.activities)


RANKED = LAPS + f""", g as (select section_sport, section_id, list(lap_time order by date, activity_id, start_index) t, min(lap_time) best, avg(lap_time) mean, stddev_pop(lap_time) sd, max(date) last, count(*) n from laps where lap_time > 0 group by 1, 2),
    h as (select *, greatest(max(n) over (partition by section_sport), 2) most, list_sort(t[-3:])[2] recent, list_sort(t[greatest(n - 5, 1):greatest(n - 5, 1) + 2])[2] before from g),
    c as (select *, case when n >= 6 then case when before > 0 then (before - recent) / before else 0 end else case when t[1] > 0 then (t[1] - t[-1]) / t[1] else 0 end end change,
        greatest(floor({NOW} / 86400) - floor(last / 86400), 0)::bigint as ndays from h),
    s as (select *, case when n >= 3 then (greatest(least(change, 1), -1) + 1) / 2 else 0.5 end improvement, case when n >= 3 and sd > 0 then least(abs((t[-1] - mean) / sd) / 3, 1) else 0 end anomaly, case when n >= 2 then ln(n) / ln(most) else 0.1 end engagement from c),
    ranked as (select section_sport, section_id, round(0.35 * exp(-ndays / 14.0::double) + 0.30 * improvement + 0.20 * anomaly + 0.15 * engagement, 6)::double relevance, round(improvement, 6)::double improvement, round(anomaly, 6)::double anomaly, round(engagement, 6)::double engagement,
        n traversals, best, case when n >= 3 then recent else list_sort(t)[(n // 2) + 1] end median_recent, ndays days_since_last, case when n < 2 then 0 when change > 0.02 then 1 when change < -0.02 then -1 else 0 end trend, abs(t[-1] - best) < 0.01 latest_is_pr from s)"""


@query("g29_w8_w9_ranked_sections", RANKED + " select * from ranked")
def ranked(t):
    return op.ranked(laps(t), NOW)


@query("o2_o7_top_ranked_by_sport", RANKED + " select *, (row_number() over (partition by section_sport order by relevance desc, section_id))::int rank from ranked qualify rank <= 10")
def top_ranked(t):
    return op.top_ranked(op.ranked(laps(t), NOW), 10)


@query("a19_calendar_summary", LAPS + """, r as (select *, year(make_timestamp(date * 1000000)) as year, month(make_timestamp(date * 1000000)) as month, case when direction in ('reverse', 'backward') then 'reverse' else 'forward' end side from laps where lap_time > 0)
    select section_id, year::int as year, month::int as month, side, min(lap_time) best_time, arg_min(activity_id, struct_pack(a := lap_time, b := date, c := activity_id)) best_activity, count(*) laps from r group by all""")
def calendar(t):
    return op.calendar(laps(t))


@query("g31_w10_section_chart", LAPS + """, r as (select section_id, activity_id, start_index, lap_time, lap_pace, (row_number() over (partition by section_id order by lap_pace desc, date, activity_id, start_index))::int rank from laps where lap_pace > 0)
    select *, min(rank) over (partition by section_id, activity_id) best_rank from r""")
def chart(t):
    return op.chart(laps(t))


@query("w27_lap_ordinals", "select section_id, activity_id, start_index, (row_number() over (partition by section_id, activity_id order by start_index) - 1)::int lap from traversals where not excluded")
def ordinals(t):
    from pyspark.sql import Window

    return t.traversals.filter(~F.col("excluded")).select("section_id", "activity_id", "start_index", (F.row_number().over(Window.partitionBy("section_id", "activity_id").orderBy("start_index")) - 1).alias("lap"))


EFFICIENCY = LAPS + """, e as (select *, lap_time * 1000 / distance_meters pace from laps where lap_time > 0 and distance_meters > 0 and avg_hr > 0), k as (select *, pace between 60 and 1800 ok from e),
    d as (select *, (date - min(case when ok then date end) over (partition by section_id)) / 86400.0::double as day from k),
    g as (select section_id, count(*) effort_count, count(case when ok then 1 end) n, covar_pop(case when ok then avg_hr / pace end, case when ok then day end) c, var_pop(case when ok then day end) v, avg(case when ok then pace end) mean_pace, max(case when ok then day end) range_days from d group by 1),
    s as (select *, case when v > 1e-12 then c / v else 0 end slope from g where n >= 3),
    eff as (select section_id, effort_count, round(slope, 8) slope, round(slope * mean_pace * range_days, 4) hr_change, slope < -0.001 and n >= 5 improving from s)"""


@query("a28_efficiency_trend", EFFICIENCY + " select * from eff")
def efficiency(t):
    hr = t.traversals.select("section_id", "activity_id", "start_index", F.col("avg_hr").alias("lap_hr"))
    return op.efficiency_trend(laps(t), hr)


@query("j7_j19_missing_streams", "select distinct activity_id from traversals where lap_time is null and activity_id not in (select track_id from points)")
def missing(t):
    return op.missing_streams(t.traversals, t.points.select(F.col("track_id").alias("activity_id")))


@query("g33_record_sections_of_activity", LAPS + ", " + _best("best", "true") + " select best_activity activity_id, count(*) sections, min(section_id) first_section from best group by 1")
def record_sections(t):
    return op.section_records(laps(t)).filter("best_activity is not null").groupBy(F.col("best_activity").alias("activity_id")).agg(F.count(F.lit(1)).alias("sections"), F.min("section_id").alias("first_section"))


@query("g35_recent_records", LAPS + ", " + _best("best", "true") + f", v as (select section_id, count(*) laps from traversals where not excluded group by 1 having count(*) >= 3) select section_id, best_activity, best_time, m.date, v.laps from best join metrics m on activity_id = best_activity join v using (section_id) where m.date between {NOW} - 604800 and {NOW}")
def recent(t):
    return op.recent_records(op.section_records(laps(t)), t.metrics, op.visit_counts(t.traversals), NOW)


@query("g30_workout_sections", RANKED + ", v as (select section_id, count(*) laps from traversals where not excluded group by 1) select section_id, relevance, trend, laps from ranked join v using (section_id) where laps >= 5 and section_sport = 'Run' order by relevance desc, section_id limit 20")
def workout(t):
    return op.ranked(laps(t), NOW).join(op.visit_counts(t.traversals), "section_id").filter("laps >= 5 and section_sport = 'Run'").select("section_id", "relevance", "trend", "laps").orderBy(F.desc("relevance"), "section_id").limit(20)
