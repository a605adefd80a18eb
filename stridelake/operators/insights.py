"""Insight candidates, gates, scores and the surface mix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.spatial import near_box
from stridelake.functions import scalar as S

# Score of each category, and the caps of the surface.
CATEGORY_BASE = {
    "section_pr": 15, "efficiency_trend": 12, "stale_pr": 10, "fitness_milestone": 10, "hrv_trend": 8, "section_trend": 7,
    "strength_balance": 6, "period_comparison": 5, "strength_progression": 4,
}
MAX_TOTAL, MAX_PER_CATEGORY, MORE_ROOM = 8, 2, {"section_pr": 3, "stale_pr": 3}
SIGNAL_FLOOR, SIGNAL_CEILING, ACTIVE_DAYS = 0.5, 2.0, 28
RECENCY = {"section_pr": (0, 14), "stale_pr": (30, 180), "period_comparison": (0, 7)}
LEAST_REPEATS = {"section_trend": 3, "efficiency_trend": 3, "stale_pr": 2, "strength_balance": 4}

COLUMNS = "subject string, category string, priority int, confidence double, title string, age_days long, repeats long, signal double, marks int, is_self boolean"


def candidate(df: DataFrame, subject, category: str, priority: int, confidence, title, age, repeats, signal, marks: int, is_self: bool = True) -> DataFrame:
    """Rows in the common shape of candidates. marks counts number, place and date among what the text names."""
    return df.select(marked(subject, category, priority, confidence, title, age, repeats, signal, marks, is_self).alias("c")).select("c.*")


def marked(subject, category: str, priority: int, confidence, title, age, repeats, signal, marks: int, is_self: bool = True) -> Column:
    """A candidate as a struct."""
    return F.struct(
        F.col(subject).cast("string").alias("subject"), F.lit(category).alias("category"), F.lit(priority).alias("priority"), F.lit(confidence).cast("double").alias("confidence"),
        title.alias("title"), age.cast("long").alias("age_days"), repeats.cast("long").alias("repeats"), signal.cast("double").alias("signal"), F.lit(marks).alias("marks"), F.lit(is_self).alias("is_self"),
    )


def candidates(df: DataFrame, *made: tuple[Column, Column]) -> DataFrame:
    """Candidates of several kinds from each row, in one pass: (where, marked(...)) for each kind."""
    some = F.filter(F.array(*(F.when(where, c) for where, c in made)), lambda c: c.isNotNull())
    return df.select(F.inline(some))


def gates(c: DataFrame) -> DataFrame:
    """Candidates that pass recency, repetition and wording."""
    recency = F.lit(False)
    for name, (lo, hi) in RECENCY.items():
        recency = recency | ((F.col("category") == name) & F.col("age_days").between(lo, hi))
    recency = recency | (~F.col("category").isin(list(RECENCY)) & (F.col("age_days") <= ACTIVE_DAYS))
    least = F.lit(0)
    for name, n in LEAST_REPEATS.items():
        least = F.when(F.col("category") == name, n).otherwise(least)
    return c.filter(recency & (F.col("repeats") >= least) & ~S.punitive(F.col("title")))


def near(c: DataFrame, lat: Column, lng: Column, min_lat: float, max_lat: float, min_lng: float, max_lng: float, pad_km: float = 25.0) -> DataFrame:
    """Rows within the active region widened by pad_km."""
    return c.filter(near_box(min_lat, max_lat, min_lng, max_lng, 1000 * pad_km, (lat, lat), (lng, lng)))


def scored(c: DataFrame) -> DataFrame:
    """Score: priority, confidence, category, specificity, framing against oneself, and signal strength."""
    base = F.lit(0)
    for name, n in CATEGORY_BASE.items():
        base = F.when(F.col("category") == name, n).otherwise(base)
    specific = F.when(F.col("marks") == 3, 10).when(F.col("marks") == 2, 5).otherwise(0)
    d = F.abs("signal")
    signal = F.when(d.isNull() | F.isnan(d), 0).when(d.between(SIGNAL_FLOOR, SIGNAL_CEILING), 10).when(d > SIGNAL_CEILING, 3).otherwise(-5)
    total = (6 - F.col("priority")) * 50 + F.coalesce("confidence", F.lit(0.5)) * 30 + base + specific + F.when(F.col("is_self"), 5).otherwise(0) + signal
    return c.withColumn("score", F.round(total, 6))


def consolidated(s: DataFrame) -> DataFrame:
    """Of the candidates about one subject, the best-scored."""
    w = Window.partitionBy("subject").orderBy(F.desc("score"), "priority", "category")
    return s.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def mixed(s: DataFrame) -> DataFrame:
    """The surface: best first, at most so many of a category, at most MAX_TOTAL.

    A category's cap depends only on the order within it, so ranks per
    category come first and leave a table of at most 3 rows a category; the
    total cap is a top-k over that.
    """
    cap = F.lit(MAX_PER_CATEGORY)
    for name, n in MORE_ROOM.items():
        cap = F.when(F.col("category") == name, n).otherwise(cap)
    w = Window.partitionBy("category").orderBy(F.desc("score"), "priority", "subject")
    few = s.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(MAX_PER_CATEGORY, *MORE_ROOM.values())).filter(F.col("_k") <= cap).drop("_k")
    return few.orderBy(F.desc("score"), "priority", "category", "subject").limit(MAX_TOTAL)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def period_comparison(metrics: DataFrame, monday: int) -> DataFrame:
    """This week against the last, by load (by time where there is none); a change needs 15 %. Rest weeks have no activities."""
    week = 7 * 86400
    now, last = F.col("date").between(monday, monday + week), F.col("date").between(monday - week, monday)
    s = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0.0))
    g = metrics.filter(F.col("date").between(monday - week, monday + week)).agg(
        F.round(s("training_load", now), 4).alias("load"), F.round(s("training_load", last), 4).alias("last_load"), F.count(F.when(now, 1)).alias("n"), F.count(F.when(last, 1)).alias("last_n")
    )
    change = F.when(F.col("last_load") > 0, F.col("load") / F.col("last_load") - 1)
    kind = F.when((F.col("n") == 0) & (F.col("last_n") > 0), "rest_week").when(change >= 0.15, "more").when(change <= -0.15, "less").otherwise("steady")
    return g.select("load", "last_load", "n", "last_n", F.round(change, 9).alias("change"), kind.alias("kind"))


def chronic_average(metrics: DataFrame, monday: int) -> DataFrame:
    """Load from 28 days before Monday to the Monday before it, over four: the span is three weeks, the divisor four."""
    rows = metrics.filter(F.col("date").between(monday - 28 * 86400, monday - 7 * 86400))
    return rows.agg(F.round(F.coalesce(F.sum("training_load"), F.lit(0.0)) / 4, 6).alias("chronic"), F.count(F.lit(1)).alias("activities"))


def stale_records(records: DataFrame, dates: DataFrame, ranked: DataFrame, now: int, gain_pct: float, gain_floor: float = 3.0, least_days: int = 30, top: int = 20) -> DataFrame:
    """Sections whose record is old while the athlete got fitter, by traversals. No rows for a gain below the floor."""
    return stale_ranked(records.join(ranked.select("section_id", "traversals", "section_sport"), "section_id"), dates, now, gain_pct, gain_floor, least_days, top)


def stale_ranked(ranked: DataFrame, dates: DataFrame, now: int, gain_pct: float, gain_floor: float = 3.0, least_days: int = 30, top: int = 20) -> DataFrame:
    """stale_records() of ranked sections that have their record with them (best_time, best_activity)."""
    rows = ranked.join(dates, F.col("best_activity") == F.col("activity_id")).withColumn("days", S.calendar_days_between(F.col("date"), F.lit(now))).filter(F.col("days") >= least_days)
    return rows.filter(F.lit(gain_pct >= gain_floor)).select("section_id", "section_sport", "best_time", "days", "traversals").orderBy(F.desc("traversals"), F.desc("days"), "section_id").limit(top)
