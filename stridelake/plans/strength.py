"""Strength queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators import strength as op
from stridelake.plans.registry import query

START, END = 820454400, 978307200
WEEKS = [(i, START + i * 7 * 86400, START + (i + 1) * 7 * 86400 - 1) for i in range(12)]


def _q(s):
    return "'" + s.replace("'", "''") + "'"


DIM = ", mus(exercise_category, muscle, intensity) as (values " + ", ".join(f"({c}, {_q(m)}, {k})" for c, m, k in S.muscle_rows()) + "), ex(exercise_category, exercise) as (values " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(S.EXERCISES)) + ")"
SETS = DIM + f""", st as (select s.*, m.date, coalesce(ex.exercise, 'Exercise ' || s.exercise_category) exercise from exercise_sets s join metrics m using (activity_id) left join ex using (exercise_category)
    where set_type = 0 and sport_type = 'WeightTraining' and m.date between {START} and {END})"""
W = "count(case when intensity = 2 then 1 end) + 0.5::double * count(case when intensity = 1 then 1 end)"
SUMMARY = SETS + f""", summ as (select muscle, count(case when intensity = 2 then 1 end) primary_sets, count(case when intensity = 1 then 1 end) secondary_sets, {W} weighted_sets,
    coalesce(sum(case when intensity = 2 then coalesce(repetitions, 0) end), 0)::bigint reps, round(coalesce(sum(case when intensity = 2 then coalesce(repetitions, 1) * coalesce(weight_kg, 0) end), 0), 2) volume,
    string_agg(distinct exercise, ',' order by exercise) exercises from st join mus using (exercise_category) group by 1)"""


def sets(t):
    return op.active_sets(t.exercise_sets, t.metrics, START, END)


@query("j8_strength_sets", SETS + " select activity_id, set_order, exercise, repetitions, weight_kg, date from st")
def strength_sets(t):
    return sets(t).select("activity_id", "set_order", "exercise", "repetitions", "weight_kg", "date")


@query("a20_muscle_summary", SUMMARY + " select * from summ")
def summary(t):
    return op.muscle_summary(sets(t))


@query("a12_strength_activity_count", SETS + " select count(distinct activity_id) activities from st")
def count(t):
    return sets(t).agg(F.countDistinct("activity_id").alias("activities"))


RANGES = ", rng(range_id, s, e) as (values " + ", ".join(f"({i}, {a}, {b})" for i, a, b in WEEKS) + ")"


@query("a21_muscle_series", SETS + RANGES + f" select range_id, muscle, {W} weighted_sets from st join rng on date between s and e join mus using (exercise_category) group by 1, 2")
def series(t):
    return op.ranged_summary(sets(t), t.spark.createDataFrame(WEEKS, "range_id int, start long, end long"))


@query("a22_exercises_for_muscle", SETS + """ select exercise_category, exercise, count(*) sets, round(sum(coalesce(repetitions, 1) * coalesce(weight_kg, 0)), 2) volume, count(distinct activity_id) activities,
    round(greatest(floor((max(date) - min(date)) / 86400), 1) / count(distinct activity_id), 9)::double frequency_days from st join mus using (exercise_category) where muscle = 'gluteal' group by 1, 2""")
def for_muscle(t):
    return op.exercises_of_muscle(sets(t), "gluteal")


@query("a23_activities_for_exercise", SETS + " select activity_id, any_value(date) date, count(*) sets, max(weight_kg) max_weight from st where exercise_category = 28 group by 1")
def for_exercise(t):
    return sets(t).filter("exercise_category = 28").groupBy("activity_id").agg(F.first("date").alias("date"), F.count(F.lit(1)).alias("sets"), F.max("weight_kg").alias("max_weight")).orderBy(F.desc("date"))


@query("a24_muscle_detail", SETS + " select exercise, max(intensity) role, count(*) sets, round(sum(coalesce(repetitions, 1) * coalesce(weight_kg, 0)), 2) volume from st join mus using (exercise_category) where muscle = 'deltoids' group by 1")
def detail(t):
    return op.muscle_detail(sets(t), "deltoids")


@query("a25_muscles_of_activity", SETS + " select activity_id, muscle, max(intensity) intensity from st join mus using (exercise_category) group by 1, 2")
def of_activity(t):
    return sets(t).join(op.muscle_dim(t.spark), "exercise_category").groupBy("activity_id", "muscle").agg(F.max("intensity").alias("intensity"))


PAIRS = ", prs(l, r) as (values " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in op.BALANCE_PAIRS) + ")"


@query("i10_strength_balance", SUMMARY + PAIRS + """, b as (select l, r, coalesce(x.weighted_sets, 0) a, coalesce(y.weighted_sets, 0) b from prs left join summ x on x.muscle = l left join summ y on y.muscle = r), k as (select *, greatest(a, b) / nullif(least(a, b), 0) q from b where a + b >= 4)
    select l left_muscle, r right_muscle, round(q, 9) ratio, case when least(a, b) = 0 then 'one_sided' when q >= 2 then 'strong' when q >= 1.35 then 'moderate' else 'balanced' end severity from k""")
def balance(t):
    return op.balance(op.muscle_summary(sets(t)))


@query("i9_strength_progression", SETS + f""", w as (select muscle, date // 2419200 as wk, {W} v from st join mus using (exercise_category) group by 1, 2), g as (select muscle, list(v order by wk) v from w group by 1 having count(*) >= 4),
    k as (select muscle, v[1] + v[2] a, v[-1] + v[-2] b from g) select muscle, a first_two, b last_two, round((b - a) / a * 100, 7) change_pct, case when (b - a) / a * 100 >= 15 then 'up' when (b - a) / a * 100 <= -15 then 'down' else 'steady' end trend from k""")
def progression(t):
    rows = sets(t).join(op.muscle_dim(t.spark), "exercise_category").withColumn("week", F.floor(F.col("date") / 2419200))
    p = F.col("intensity") == 2
    return op.progression(rows.groupBy("muscle", "week").agg((F.count(F.when(p, 1)) + 0.5 * F.count(F.when(~p, 1))).alias("weighted_sets")))
