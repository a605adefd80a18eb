"""Strength training: sets, muscles, balance and progression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions import scalar as S

#: Muscle pairs whose load is compared.
BALANCE_PAIRS = [("chest", "upper-back"), ("quadriceps", "hamstring"), ("biceps", "triceps"), ("abs", "lower-back")]


def muscle_dim(spark: SparkSession) -> DataFrame:
    """Category, muscle, intensity: under a hundred fixed rows, broadcast in joins."""
    return F.broadcast(spark.createDataFrame(S.muscle_rows(), "exercise_category int, muscle string, intensity int"))


def active_sets(sets: DataFrame, metrics: DataFrame, start: int, end: int) -> DataFrame:
    """Working sets of strength sessions in a period."""
    m = metrics.filter((F.col("sport_type") == "WeightTraining") & F.col("date").between(start, end)).select("activity_id", "date")
    return sets.filter("set_type = 0").join(m, "activity_id").withColumn("exercise", S.exercise_name(F.col("exercise_category")))


def muscle_summary(sets: DataFrame) -> DataFrame:
    """Per muscle: primary and secondary sets, weighted sets, repetitions and volume of primary sets, exercises.

    Missing repetitions count 0 as repetitions and 1 in the volume.
    """
    p = F.col("intensity") == 2
    n = lambda c: F.count(F.when(c, 1))
    reps = F.coalesce(F.sum(F.when(p, F.coalesce("repetitions", F.lit(0)))), F.lit(0))
    volume = F.coalesce(F.sum(F.when(p, F.coalesce("repetitions", F.lit(1)) * F.coalesce("weight_kg", F.lit(0.0)))), F.lit(0.0))
    return sets.join(muscle_dim(sets.sparkSession), "exercise_category").groupBy("muscle").agg(
        n(p).alias("primary_sets"), n(~p).alias("secondary_sets"), (n(p) + 0.5 * n(~p)).alias("weighted_sets"), reps.cast("long").alias("reps"), F.round(volume, 2).alias("volume"),
        F.concat_ws(",", F.array_sort(F.collect_set("exercise"))).alias("exercises"),
    )


def exercises_of_muscle(sets: DataFrame, muscle: str) -> DataFrame:
    """Per exercise of a muscle: sets, volume, sessions, days between sessions."""
    d = muscle_dim(sets.sparkSession).filter(F.col("muscle") == muscle)
    acts = F.countDistinct("activity_id")
    days = F.greatest(F.floor((F.max("date") - F.min("date")) / 86400), F.lit(1))
    volume = F.sum(F.coalesce("repetitions", F.lit(1)) * F.coalesce("weight_kg", F.lit(0.0)))
    return sets.join(d, "exercise_category").groupBy("exercise_category", "exercise").agg(
        F.count(F.lit(1)).alias("sets"), F.round(volume, 2).alias("volume"), acts.alias("activities"), F.round(days / acts, 9).alias("frequency_days")
    )


def muscle_detail(sets: DataFrame, muscle: str) -> DataFrame:
    """Per exercise name of a muscle: the stronger role, sets, volume; primary ones first."""
    d = muscle_dim(sets.sparkSession).filter(F.col("muscle") == muscle)
    volume = F.sum(F.coalesce("repetitions", F.lit(1)) * F.coalesce("weight_kg", F.lit(0.0)))
    return sets.join(d, "exercise_category").groupBy("exercise").agg(F.max("intensity").alias("role"), F.count(F.lit(1)).alias("sets"), F.round(volume, 2).alias("volume")).orderBy(F.desc("role"), F.desc("volume"))


def ranged_summary(sets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Weighted sets of each muscle in each of a few ranges (range_id, start, end); a set counts in every range it falls in."""
    rows = sets.join(F.broadcast(ranges), F.col("date").between(F.col("start"), F.col("end"))).join(muscle_dim(sets.sparkSession), "exercise_category")
    p = F.col("intensity") == 2
    return rows.groupBy("range_id", "muscle").agg((F.count(F.when(p, 1)) + 0.5 * F.count(F.when(~p, 1))).alias("weighted_sets"))


def balance(summary: DataFrame, least: float = 4.0) -> DataFrame:
    """Muscle pairs with at least `least` weighted sets in all: ratio of the larger to the smaller and its class.

    One-sided pairs (nothing on one side) have no ratio; severity falls from
    one-sided over 2 and 1.35 to balanced.
    """
    spark = summary.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BALANCE_PAIRS)], "pair int, left_muscle string, right_muscle string"))
    s = summary.select("muscle", "weighted_sets")
    both = (
        pairs.join(s.withColumnsRenamed({"muscle": "left_muscle", "weighted_sets": "a"}), "left_muscle", "left")
        .join(s.withColumnsRenamed({"muscle": "right_muscle", "weighted_sets": "b"}), "right_muscle", "left").fillna(0.0, ["a", "b"]).filter(F.col("a") + F.col("b") >= least)
    )
    low, high = F.least("a", "b"), F.greatest("a", "b")
    r = F.when(low > 0, high / low)
    kind = F.when(low == 0, "one_sided").when(r >= 2, "strong").when(r >= 1.35, "moderate").otherwise("balanced")
    return both.select("left_muscle", "right_muscle", F.round(r, 9).alias("ratio"), kind.alias("severity"))


def progression(weekly: DataFrame) -> DataFrame:
    """First two weeks' weighted sets against the last two, by muscle; up or down beyond 15 %. weekly: muscle, week, weighted_sets."""
    g = weekly.groupBy("muscle").agg(F.array_sort(F.collect_list(F.struct("week", "weighted_sets"))).alias("h")).filter(F.size("h") >= 4)
    v = F.transform("h", lambda x: x["weighted_sets"])
    a, b = F.get(v, 0) + F.get(v, 1), F.element_at(v, -1) + F.element_at(v, -2)
    pct = F.when(a > 0, (b - a) / a * 100)
    return g.select("muscle", a.alias("first_two"), b.alias("last_two"), F.round(pct, 7).alias("change_pct"), F.when(pct >= 15, "up").when(pct <= -15, "down").otherwise("steady").alias("trend"))
