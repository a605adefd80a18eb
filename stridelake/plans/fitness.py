"""Fitness and wellness queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators import fitness as op
from stridelake.plans.registry import query

START, END = 820454400, 915148800  # 1996-01-01 to 1999-01-01


@query("a1_period_stats", f"""select count(*) as count, coalesce(sum(moving_time), 0)::bigint moving_time, round(coalesce(sum(distance), 0), 2) distance,
    round(coalesce(sum(training_load), 0), 3) training_load from metrics where date between {START} and {END}""")
def a1(t):
    return op.period_stats(t.metrics, START, END)


def _zones(sport, shares):
    cols = " union all ".join(f"select {i + 1} zone, sum(floor(moving_time * {s}))::bigint as seconds from metrics where sport_type = '{sport}'" for i, s in enumerate(shares))
    return f", z as ({cols}), p as (select zone, seconds, floor(100.0::double * seconds / sum(seconds) over () + 0.5)::bigint as percent from z)"


@query("a2_zone_distribution_power", _zones("Ride", [f"{s}::double" for s in op.POWER_SHARES]) + "select * from p")
def a2(t):
    return op.zone_distribution(t.metrics, "Ride", "power")


@query("a3_zone_percentages_hr", _zones("Run", [f"{s}::double" for s in op.HR_SHARES]) + "select zone, percent from p")
def a3(t):
    return op.zone_distribution(t.metrics, "Run", "hr").select("zone", "percent")


@query("a4_stream_zone_histogram", """select case when value < 10 then 1 when value < 50 then 2 when value < 120 then 3 else 4 end zone, count(*) samples
    from points where value >= 0 and value < 1000 group by 1""")
def a4(t):
    return op.stream_zones(t.points, "value", [0, 10, 50, 120, 1000])


@query("a5_dominant_zone", _zones("Run", [f"{s}::double" for s in op.HR_SHARES]) + "select zone, percent from p where percent > 0 order by percent desc, zone limit 1")
def a5(t):
    return op.dominant_zone(op.zone_distribution(t.metrics, "Run", "hr"))


@query("a6_daily_heatmap", """select strftime(make_timestamp(date * 1000000), '%Y-%m-%d') as day,
    case when max(moving_time) > 7200 then 4 when max(moving_time) > 5400 then 3 when max(moving_time) > 3600 then 2 when max(moving_time) > 0 then 1 else 0 end intensity,
    max(moving_time) max_duration, count(*) activity_count from metrics group by 1""")
def a6(t):
    return op.day_heatmap(t.metrics)


@query("a11_distinct_sports", "select distinct sport_type from metrics")
def a11(t):
    return t.metrics.select("sport_type").distinct().orderBy("sport_type")


@query("a13_bounds_union", f"""select round(min(min_lat), 6) min_lat, round(max(max_lat), 6) max_lat, round(min(min_lng), 6) min_lng, round(max(max_lng), 6) max_lng
    from activities join metrics using (activity_id) where date between {START} and {END} and metrics.sport_type in ('Ride', 'Run')""")
def a13(t):
    return op.bounds_union(t.activities, t.metrics, START, END, ["Ride", "Run"])


@query("w12_ftp_change", """, r as (select *, row_number() over (order by date desc, activity_id desc) n from metrics where ftp is not null and sport_type in ('Ride') qualify n <= 20),
    l as (select ftp latest, date latest_date from r where n = 1)
    select latest, latest_date, (select ftp from r where ftp <> latest order by n limit 1) previous, (select date from r where ftp <> latest order by n limit 1) previous_date from l""")
def w12(t):
    return op.threshold_change(t.metrics, "ftp", op.FTP_SPORTS)


@query("w13_pace_change", """, m as (select *, round(distance / moving_time, 6) cs from metrics where moving_time > 0), r as (select *, row_number() over (order by date desc, activity_id desc) n from m where sport_type = 'Run' qualify n <= 20),
    l as (select cs latest, date latest_date from r where n = 1)
    select latest, latest_date, (select cs from r, l where abs(cs - latest) > 0.02 order by n limit 1) previous, (select date from r, l where abs(cs - latest) > 0.02 order by n limit 1) previous_date from l""")
def w13(t):
    m = t.metrics.filter("moving_time > 0").withColumn("cs", F.round(F.col("distance") / F.col("moving_time"), 6))
    return op.threshold_change(m, "cs", ["Run"], gap=0.02)


@query("w14_hrv_forward_fill", """, r as (select * from wellness order by date desc limit 21)
    select date, round(coalesce(last_value(hrv ignore nulls) over (order by date rows unbounded preceding), first_value(hrv ignore nulls) over (order by date rows between unbounded preceding and unbounded following)))::bigint filled
    from r qualify filled is not null""")
def w14(t):
    return op.forward_filled(t.wellness, "hrv", 21)


@query("w15_wellness_last_rows", "select * from wellness order by date desc limit 14")
def w15(t):
    return t.wellness.orderBy(F.desc("date")).limit(14)


@query("w16_wellness_sparklines", """, r as (select * from wellness order by date desc limit 28)
    select row_number() over (order by date)::int n, date, round(coalesce(ctl, 0))::bigint fitness, round(coalesce(atl, 0))::bigint fatigue, round(coalesce(ctl, 0) - coalesce(atl, 0))::bigint form,
    (floor(coalesce(ctl, 0) + 0.5) - floor(coalesce(atl, 0) + 0.5))::bigint form_rounded_parts,
    case when ctl - atl < -30 then 'highRisk' when ctl - atl < -10 then 'optimal' when ctl - atl < 5 then 'greyZone' when ctl - atl < 25 then 'fresh' else 'transition' end zone from r""")
def w16(t):
    return op.heart_series(t.wellness, 28)


@query("a29_hrv_trend", """, r as (select * from (select * from wellness order by date desc limit 28) where hrv > 0), v as (select list(hrv order by date) v, count(*) n from r),
    h as (select *, list_avg(v[1:(n // 2)]) f, list_avg(v[(n // 2) + 1:]) s, v[n] < v[n - 1] and v[n - 1] < v[n - 2] falls from v where n >= 5)
    select n::int points, round(list_avg(v), 4) average, round(v[n], 4) latest, round(f, 4) first_half, round(s, 4) second_half,
    case when s > f * 1.02 and not falls then 'improving' when s < f * 0.98 or falls then 'declining' else 'stable' end trend from h""")
def a29(t):
    return op.hrv_trend(t.wellness, 28)


@query("a27_regression_by_sport", """, g as (select sport_type, count(*) n, avg(moving_time) mx, avg(distance) my, var_pop(moving_time) vx, covar_pop(moving_time, distance) c from metrics group by 1)
    select sport_type, n, round(case when vx > 1e-12 then c / vx else 0 end, 5) slope, round(my - case when vx > 1e-12 then c / vx else 0 end * mx, 3) intercept from g""")
def a27(t):
    return op.regression(t.metrics, "moving_time", "distance", ["sport_type"]).select("sport_type", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("a30_median_by_sport", "select sport_type, median(moving_time)::double median_time from metrics group by 1")
def a30(t):
    return t.metrics.groupBy("sport_type").agg(F.median("moving_time").alias("median_time"))


@query("a31_upper_middle_by_route", "select route_id, list_sort(list(moving_time))[(count(*) // 2) + 1] upper_middle from metrics group by 1")
def a31(t):
    """By rank, so no route's times are gathered."""
    w = Window.partitionBy("route_id")
    r = t.metrics.select("route_id", "moving_time", F.row_number().over(w.orderBy("moving_time")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return r.filter("k = n div 2 + 1").select("route_id", F.col("moving_time").alias("upper_middle"))


@query("a32_elevation_gain", """, d as (select track_id, value - lag(value) over (partition by track_id order by t, point_id) d from points)
    select track_id, round(coalesce(sum(greatest(d, 0)), 0), 3) gain from d group by 1""")
def a32(t):
    rise = F.col("value") - F.lag("value").over(Window.partitionBy("track_id").orderBy("t", "point_id"))
    return t.points.select("track_id", rise.alias("rise")).groupBy("track_id").agg(F.round(F.coalesce(F.sum(F.greatest("rise", F.lit(0.0))), F.lit(0.0)), 3).alias("gain"))


@query("a33_decoupling", """, r as (select *, 100 + point_id % 50 hr, row_number() over (partition by track_id order by t, point_id) i, count(*) over (partition by track_id) n from points where value > 0),
    g as (select track_id, avg(case when i <= n // 2 then value end) / avg(case when i <= n // 2 then hr end) a, avg(case when i > n // 2 then value end) / avg(case when i > n // 2 then hr end) b from r where n >= 4 group by 1)
    select track_id, round((a - b) / a * 100, 4) decoupling, round((a - b) / a * 100, 4) < 5 good from g""")
def a33(t):
    return op.decoupling(t.points.withColumn("hr", 100 + F.col("point_id") % 50), "track_id", "value", "hr")


@query("a34_a37_activity_summary", "select track_id, round(avg(case when value > 0 then value end), 4) avg_positive, count(*) samples, (max(t) - min(t))::bigint elapsed from points group by 1")
def a37(t):
    return t.points.groupBy("track_id").agg(F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 4).alias("avg_positive"), F.count(F.lit(1)).alias("samples"), (F.max("t") - F.min("t")).alias("elapsed"))


@query("a36_same_type_averages", "select sport_type, round(avg(coalesce(training_load, 0)), 4) load, round(avg(coalesce(ftp, 0)), 4) ftp, round(avg(avg_hr), 4) hr from metrics group by 1")
def a36(t):
    return t.metrics.groupBy("sport_type").agg(
        F.round(F.avg(F.coalesce("training_load", F.lit(0))), 4).alias("load"), F.round(F.avg(F.coalesce("ftp", F.lit(0))), 4).alias("ftp"), F.round(F.avg("avg_hr"), 4).alias("hr")
    )


@query("w25_downsampled_ftp_history", """, r as (select route_id, activity_id, date, ftp, row_number() over w i, count(*) over (partition by route_id) n from metrics where ftp is not null window w as (partition by route_id order by date, activity_id))
    select route_id, activity_id, date, ftp from r where (i - 1) % greatest(n // 5, 1) = 0 or i = n""")
def w25(t):
    return op.even_steps(t.metrics.filter("ftp is not null"), ["route_id"], ["date", "activity_id"], 5).select("route_id", "activity_id", "date", "ftp")


@query("w26_split_times", """, d as (select *, sum(abs(value)) over (partition by track_id order by t, point_id rows unbounded preceding) c from points)
    select track_id, floor(c / 1000)::bigint split, min(t) reached from d where floor(c / 1000) >= 1 group by 1, 2""")
def w26(t):
    """First time in each whole thousand of the running sum, which is one of decimals: a sum of doubles may miss a thousand that is met exactly."""
    c = F.sum(F.abs("value").cast("decimal(18,4)")).over(Window.partitionBy("track_id").orderBy("t", "point_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.points.withColumn("split", F.floor(c / 1000)).filter("split >= 1").groupBy("track_id", "split").agg(F.min("t").alias("reached"))


@query("f_scalar_dates", """select activity_id, strftime(make_timestamp(date * 1000000), '%Y-%m-%d') as day, (isodow(make_timestamp(date * 1000000)) - 1)::int dow, week(make_timestamp(date * 1000000))::int iso_week,
    case when month(make_timestamp(date * 1000000)) in (12, 1, 2) then 'winter' when month(make_timestamp(date * 1000000)) in (3, 4, 5) then 'spring' when month(make_timestamp(date * 1000000)) in (6, 7, 8) then 'summer' else 'autumn' end season,
    greatest(floor(978307200 / 86400) - floor(date / 86400), 0)::bigint calendar_days, greatest(floor((978307200 - date) / 86400), 0)::bigint elapsed_days from metrics""")
def dates(t):
    d, now = S.epoch_date(F.col("date")), F.lit(978307200)
    return t.metrics.select(
        "activity_id", F.date_format(d, "yyyy-MM-dd").alias("day"), F.weekday(d).alias("dow"), F.weekofyear(d).alias("iso_week"), S.season(d).alias("season"),
        S.calendar_days_between(F.col("date"), now).alias("calendar_days"), S.elapsed_days(F.col("date"), now).alias("elapsed_days"),
    )


@query("f_scalar_ratios", """select activity_id, round(case when distance > 0 and moving_time > 0 then distance / moving_time else 0 end, 9) speed, round(case when distance > 0 and moving_time > 0 then moving_time * 1000 / distance else 0 end, 9) pace,
    round(case when avg_hr > 0 then training_load / avg_hr end, 12) efficiency, case when lower(sport_type) like '%run%' then 'running' when lower(sport_type) like '%hike%' then 'walking' else 'cycling' end category,
    floor(greatest((-55.0969 + 0.6309 * avg_hr + 0.1988 * 70 + 0.2017 * 35) / 4.184, 0) * moving_time / 60 + 0.5)::bigint calories from metrics""")
def ratios(t):
    d, m = F.col("distance"), F.col("moving_time")
    return t.metrics.select(
        "activity_id", F.round(S.speed(d, m), 9).alias("speed"), F.round(S.pace_per_km(d, m), 9).alias("pace"), F.round(S.ratio(F.col("training_load"), F.col("avg_hr").cast("double")), 12).alias("efficiency"),
        S.sport_category(F.col("sport_type")).alias("category"), S.calories(F.col("avg_hr"), F.lit(30), m, F.lit(70.0), F.lit(8.0)).alias("calories"),
    )
