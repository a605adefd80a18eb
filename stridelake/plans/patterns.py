"""Pattern queries. An athlete is a run of thirty customers: a history of bounded size at any scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import patterns as op
from stridelake.operators import sections as sec
from stridelake.plans.registry import query
from stridelake.plans.sections import LAPS, laps

BY = ["athlete", "sport_type"]


def features(t):
    return op.normalised(t.metrics.withColumn("athlete", F.floor(F.col("route_id") / 30)), BY)


@query("w23_normalised_features", """, a as (select *, route_id // 30 athlete, (isodow(make_timestamp(date * 1000000)) - 1)::int dow from metrics),
    b as (select *, min(moving_time) over w t0, max(moving_time) over w t1, min(training_load) over w l0, max(training_load) over w l1 from a window w as (partition by athlete, sport_type))
    select activity_id, dow, round(dow / 6.0::double, 9) f_dow, round(case when t1 > t0 then (moving_time - t0) / (t1 - t0) else 0.5 end, 9)::double f_duration, round(case when l1 > l0 then (training_load - l0) / (l1 - l0) else 0.5 end, 9)::double f_load from b""")
def w23(t):
    return features(t).select("activity_id", "dow", *(F.round(c, 9).alias(c) for c in ("f_dow", "f_duration", "f_load")))


@query("w24_mode_weekday", """, a as (select route_id // 30 athlete, sport_type, (isodow(make_timestamp(date * 1000000)) - 1)::int dow, count(*) c from metrics group by all)
    select athlete::bigint athlete, sport_type, dow primary_day from a qualify row_number() over (partition by athlete, sport_type order by c desc, dow desc) = 1""")
def w24(t):
    return op.mode_day(features(t), BY)


@query("w22_half_trend", LAPS + """, h as (select section_id, list(lap_time order by date desc, activity_id desc, start_index desc) t, count(*) n from laps where lap_time > 0 group by 1),
    m as (select section_id, n, list_avg(t[1:(n // 2)]) a, list_avg(t[(n // 2) + 1:]) b from h) select section_id, case when n < 4 then 0 when a < b * 0.97::double then 1 when a > b * 1.03::double then -1 else 0 end trend from m""")
def w22(t):
    rows = op.newest_first(laps(t).filter("lap_time > 0"), ["section_id"], ["date", "activity_id", "start_index"])
    return rows.groupBy("section_id").agg(op.half_trend("lap_time").alias("trend"))


@query("g22_g23_clusters")
def clusters(t):
    return op.clusters(features(t), BY)


@query("g24_patterns")
def patterns(t):
    f = features(t)
    return op.patterns(f, op.clusters(f, BY), BY)


@query("g26_pattern_today")
def today(t):
    f = features(t)
    return op.pattern_today(op.patterns(f, op.clusters(f, BY), BY), BY, 2, "summer")


@query("g25_pattern_sections")
def pattern_sections(t):
    """Sections as they are."""
    return op.pattern_sections(op.clusters(features(t), BY), sec.laps(t.traversals, t.sections, t.metrics), BY)
