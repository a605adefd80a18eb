"""Smoothing and chart-position queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import smoothing as op
from stridelake.plans.registry import query
from stridelake.plans.routes import MEMBERS
from stridelake.operators import routes

FIT = MEMBERS + """, d as (select route_id, date / 86400.0::double x, speed y from mem), g as (select route_id, min(x) x0, max(x) x1, count(*) n from d group by 1 having max(x) > min(x)),
    r as (select d.*, i, x0 + (x1 - x0) * i / 199.0::double as xat, exp(-0.5 * pow((x - (x0 + (x1 - x0) * i / 199.0::double)) / ((x1 - x0) / greatest(3.0::double, sqrt(n))), 2)) w from d join g using (route_id), range(200) t(i)),
    m as (select route_id, i, any_value(xat) as xat, sum(w) s0, sum(w * (x - xat)) s1, sum(w * (x - xat) * (x - xat)) s2, sum(w * y) t0, sum(w * (x - xat) * y) t1, sum(w * y * y) q from r group by 1, 2),
    f as (select *, case when abs(s0 * s2 - s1 * s1) > 1e-12 then (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) else t0 / s0 end fit from m), fits as (select route_id, i, xat, fit, sqrt(greatest(q / s0 - 2 * fit * t0 / s0 + fit * fit, 0)) sigma from f)"""


def fit(t):
    d = routes.members(t.metrics).select("route_id", (F.col("date") / 86400.0).alias("x"), F.col("speed").alias("y"))
    return op.local_linear(d, ["route_id"], "x", "y")


@query("w17_centred_average", """, d as (select sport_type, (date // 86400)::bigint as day_no, sum(training_load) load from metrics group by 1, 2)
    select sport_type, day_no, round(avg(load) over (partition by sport_type order by day_no range between 3 preceding and 3 following), 9) smoothed from d""")
def w17(t):
    d = t.metrics.groupBy("sport_type", F.floor(F.col("date") / 86400).alias("day_no")).agg(F.sum("training_load").alias("load"))
    return op.centred_average(d, ["sport_type"], "day_no", "load", 7)


@query("w18_local_linear_smoother", FIT + " select route_id, i::int i, round(xat, 4) as place, round(fit, 5) fit from fits")
def w18(t):
    return fit(t).select("route_id", "i", F.round("at", 4).alias("place"), F.round("fit", 5).alias("fit"))


@query("w19_clamped_band", FIT + ", l as (select route_id, min(y) lo, max(y) hi from d group by 1) select route_id, i::int i, round(greatest(least(fit - sigma, hi + (hi - lo) * 0.15), lo - (hi - lo) * 0.15), 4) low, round(greatest(least(fit + sigma, hi + (hi - lo) * 0.15), lo - (hi - lo) * 0.15), 4) high from fits join l using (route_id)")
def w19(t):
    return op.clamped_band(fit(t), ["route_id"]).select("route_id", "i", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("w20_lanes", MEMBERS + " select route_id, side, round(max(speed), 9) best, round(min(speed), 9) low, count(*) points, round(greatest((max(speed) - min(speed)) * 0.2, 0.5), 9) padding from mem group by 1, 2")
def w20(t):
    return op.lanes(routes.members(t.metrics), ["route_id"], "side", "speed").withColumn("best", F.round("best", 9)).withColumn("low", F.round("low", 9))


@query("w21_scatter_positions", MEMBERS + ", p as (select route_id, activity_id, date, min(date) over w lo, max(date) over w hi from mem window w as (partition by route_id)) select route_id, activity_id, round(case when hi > lo then 0.02 + 0.96::double * (date - lo) / (hi - lo) else 0.5 end, 9)::double x from p")
def w21(t):
    return op.scatter_positions(routes.members(t.metrics), ["route_id"], "date").select("route_id", "activity_id", "x")
