"""Section performances: laps, records, trends, ranking, calendars, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators.graph import ensure_checkpoint_dir


def effective_time() -> Column:
    """Lap time, or the activity's time in proportion to the distance on the section."""
    share = F.when((F.col("distance") > 0) & (F.col("distance_meters") > 0), F.col("moving_time") * (F.col("distance_meters") / F.col("distance")))
    return F.coalesce("lap_time", share)


def complete() -> Column:
    """Laps that count for records: not partial, and at least 70 % of the section if its length is known."""
    length = F.col("section_meters")
    return (F.col("direction") != "partial") & (length.isNull() | (length <= 0) | (F.col("distance_meters") >= 0.7 * length))


def laps(traversals: DataFrame, sections: DataFrame, metrics: DataFrame) -> DataFrame:
    """Included traversals with their section's and activity's columns: two equi-joins, by activity first, so that rows end up dealt by section."""
    m = metrics.select("activity_id", "date", "sport_type", "distance", "moving_time")
    s = sections.select("section_id", "section_meters", F.col("sport_type").alias("section_sport"))
    return traversals.filter(~F.col("excluded")).join(m, "activity_id").join(s, "section_id")


def activity_records(lap_rows: DataFrame) -> DataFrame:
    """One row for each section and activity: laps by start, best complete lap (by pace), means over all laps, first direction."""
    best = F.max(F.when(complete() & (F.col("lap_pace") > 0), F.struct("lap_pace", (-F.col("start_index")).alias("i"), "lap_time", "direction")))
    return lap_rows.groupBy("section_id", "activity_id").agg(
        F.first("date").alias("date"), F.count(F.lit(1)).alias("lap_count"), F.coalesce(best["lap_time"], F.lit(0.0)).alias("best_time"), F.coalesce(best["lap_pace"], F.lit(0.0)).alias("best_pace"),
        F.round(F.avg("lap_time"), 7).alias("avg_time"), F.round(F.avg("lap_pace"), 9).alias("avg_pace"), F.min(F.struct("start_index", "direction"))["direction"].alias("direction"),
        F.sort_array(F.collect_list(F.struct("start_index", "lap_time", "lap_pace"))).alias("laps"),
    )


def section_records(lap_rows: DataFrame) -> DataFrame:
    """One row for each section: best lap in each direction class by pace, and each direction's mean time, last date and number."""
    fwd = S.direction_class(F.col("direction")) == "forward"
    ok = complete() & (F.col("lap_pace") > 0)
    key = F.struct("lap_pace", (-F.col("date")).alias("d"), (-F.col("activity_id")).alias("a"), (-F.col("start_index")).alias("i"), "lap_time")
    out = []
    for name, side in (("best", F.lit(True)), ("forward", fwd), ("reverse", ~fwd)):
        best = F.max(F.when(ok & side, key))
        out += [best["lap_time"].alias(f"{name}_time"), best["lap_pace"].alias(f"{name}_pace"), (-best["a"]).alias(f"{name}_activity")]
    for name, side in (("forward", fwd), ("reverse", ~fwd)):
        out += [F.round(F.avg(F.when(side, F.col("lap_time"))), 7).alias(f"{name}_avg"), F.max(F.when(side, F.col("date"))).alias(f"{name}_last"), F.count(F.when(side, 1)).alias(f"{name}_count")]
    return lap_rows.groupBy("section_id").agg(*out)


def excluded_records(traversals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Excluded traversals by section and activity; best is the least time."""
    return traversals.filter("excluded").join(metrics.select("activity_id", "date"), "activity_id").groupBy("section_id", "activity_id").agg(
        F.first("date").alias("date"), F.min("lap_time").alias("best_time"), F.count(F.lit(1)).alias("lap_count")
    )


def visit_counts(traversals: DataFrame) -> DataFrame:
    """Laps and distinct activities of each section."""
    return traversals.filter(~F.col("excluded")).groupBy("section_id").agg(F.count(F.lit(1)).alias("laps"), F.countDistinct("activity_id").alias("activities"))


def summaries(sections: DataFrame, traversals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Visible sections with visit counts and the sorted sports of their activities."""
    sports = traversals.filter(~F.col("excluded")).join(metrics.select("activity_id", F.col("sport_type").alias("sport")), "activity_id").groupBy("section_id").agg(
        F.count(F.lit(1)).alias("visit_count"), F.concat_ws(",", F.array_sort(F.collect_set("sport"))).alias("sports")
    )
    return sections.join(sports, "section_id", "left").select("section_id", "name", "section_type", "section_meters", F.coalesce("visit_count", F.lit(0)).alias("visit_count"), F.coalesce("sports", F.lit("")).alias("sports"))


def timed(traversals: DataFrame, sections: DataFrame, activities: DataFrame) -> DataFrame:
    """Complete traversals with an effective time, dated by the activity's start (0 if unknown)."""
    a = activities.select("activity_id", F.coalesce("start_date", F.lit(0)).alias("date"), F.col("distance_meters").alias("distance"), F.col("duration_secs").alias("moving_time"))
    s = sections.select("section_id", "section_meters")
    rows = traversals.filter(~F.col("excluded")).join(s, "section_id").join(a, "activity_id").filter(complete())
    return rows.withColumn("time", effective_time()).filter("time > 0")


def indicators(timed_rows: DataFrame) -> DataFrame:
    """Records and trends of each lap within its section and direction, for pairs with two or more laps.

    The trend compares a lap with the mean of the strictly earlier ones, by
    2 %; a lap within 0.001 s of the best is a record. Records give a record
    row and a trend row, other laps a trend row if the trend is not level;
    of an activity's laps the latest counts.
    """
    w = Window.partitionBy("section_id", "direction")
    order = w.orderBy("date", "activity_id", "start_index")
    mean = F.avg("time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = timed_rows.select(
        "section_id", "direction", "activity_id", "start_index", "date", F.col("time"), F.count(F.lit(1)).over(w).alias("n"), F.min("time").over(w).alias("least"), mean.alias("mean")
    ).filter("n >= 2")
    trend = F.when(F.col("mean").isNull(), 0).when(F.col("time") < 0.98 * F.col("mean"), 1).when(F.col("time") > 1.02 * F.col("mean"), -1).otherwise(0)
    rows = rows.withColumn("trend", trend).withColumn("is_pr", F.abs(F.col("time") - F.col("least")) < 0.001)
    made = F.array(
        F.when(F.col("is_pr"), F.struct(F.lit("section_pr").alias("kind"), F.lit(1).alias("value"))),
        F.when(F.col("is_pr") | (F.col("trend") != 0), F.struct(F.lit("section_trend").alias("kind"), F.col("trend").alias("value"))),
    )
    latest = Window.partitionBy("activity_id", "kind", "section_id", "direction").orderBy(F.desc("date"), F.desc("start_index"))
    return (
        rows.select("*", F.inline(F.filter(made, lambda x: x.isNotNull())))
        .withColumn("k", F.row_number().over(latest)).filter("k = 1")
        .select("activity_id", "kind", "section_id", "direction", "value", F.round("time", 4).alias("lap_time"))
    )


def lap_history(lap_rows: DataFrame, left_dates: DataFrame) -> DataFrame:
    """Each timed lap with its place by date in its section and direction, the best time so far, and the section's figures.

    Figures: the number of visits, the best and the latest time, and whether
    the latest is within 0.5 % of the best. A lap is a row, so no section's
    laps are gathered.
    """
    d = left_dates.select("activity_id", F.coalesce("start_date", F.lit(0)).alias("start"))
    rows = lap_rows.filter("lap_time > 0").join(d, "activity_id", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    w = Window.partitionBy("section_id", "direction")
    order = w.orderBy("start", "activity_id", "start_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last("lap_time").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = F.min("lap_time").over(w)
    return rows.select(
        "section_id", "direction", "activity_id", "start_index", "lap_time", F.row_number().over(order).alias("visit"), F.min("lap_time").over(upto).alias("best_so_far"),
        F.count(F.lit(1)).over(w).alias("visit_count"), best.alias("best"), latest.alias("latest"), (latest <= best * 1.005).alias("latest_is_pr"),
    )


def ranked(lap_rows: DataFrame, now: int, best: bool = False) -> DataFrame:
    """Relevance of each section by sport: recency, improvement, anomaly and engagement.

    Only the first and the last six laps matter one by one. Laps are dealt by
    section and put in order once; the aggregation follows in the same tasks,
    so no section's laps are gathered whole. Figures of sections are kept
    (checkpoint), as the largest lap count of a sport scales engagement.
    With `best`, the record of section_records() comes along: best_time and
    best_activity.
    """
    ensure_checkpoint_dir(lap_rows.sparkSession)
    key = ["section_sport", "section_id"]
    timed = F.col("lap_time") > 0
    rows = lap_rows if best else lap_rows.filter(timed)
    newest = Window.partitionBy(*key).orderBy(F.coalesce(timed, F.lit(False)).desc(), F.desc("date"), F.desc("activity_id"), F.desc("start_index"))
    lap = F.when(timed, F.col("lap_time"))
    out = [
        F.min(F.when(timed, F.struct("date", "activity_id", "start_index", "lap_time")))["lap_time"].alias("first"), F.min(lap).alias("best"), F.avg(lap).alias("mean"),
        F.stddev_pop(lap).alias("sd"), F.max(F.when(timed, F.col("date"))).alias("last"), F.count(lap).alias("n"), *(F.max(F.when(F.col("k") == i, lap)).alias(f"t{i}") for i in range(1, 7)),
    ]
    if best:
        record = F.max(F.when(complete() & (F.col("lap_pace") > 0), F.struct("lap_pace", (-F.col("date")).alias("d"), (-F.col("activity_id")).alias("a"), (-F.col("start_index")).alias("i"), "lap_time")))
        out += [record["lap_time"].alias("best_time"), (-record["a"]).alias("best_activity")]
    g = rows.withColumn("k", F.row_number().over(newest)).groupBy(*key).agg(*out).filter("n > 0").checkpoint()
    most = g.groupBy("section_sport").agg(F.greatest(F.max("n"), F.lit(2)).alias("most"))
    g = g.join(F.broadcast(most), "section_sport").withColumn("t", F.filter(F.array(*(f"t{i}" for i in range(6, 0, -1))), lambda x: x.isNotNull()))
    t, n, first = F.col("t"), F.col("n").cast("int"), F.col("first")
    mid = lambda a: F.get(F.array_sort(a), 1)
    recent, before, latest = mid(F.slice(t, F.greatest(F.size(t) - 2, F.lit(1)), 3)), mid(F.slice(t, 1, 3)), F.element_at(t, -1)
    change = F.when(n >= 6, F.when(before > 0, (before - recent) / before).otherwise(0.0)).otherwise(F.when(first > 0, (first - latest) / first).otherwise(0.0))
    improvement = F.when(n >= 3, (F.greatest(F.least(change, F.lit(1.0)), F.lit(-1.0)) + 1) / 2).otherwise(0.5)
    anomaly = F.when((n >= 3) & (F.col("sd") > 0), F.least(F.abs((latest - F.col("mean")) / F.col("sd")) / 3, F.lit(1.0))).otherwise(0.0)
    engagement = F.when(n >= 2, F.ln(F.col("n")) / F.ln(F.col("most"))).otherwise(0.1)
    days = S.calendar_days_between(F.col("last"), F.lit(now))
    recency = F.exp(-days / 14.0)
    median_recent = F.when(n >= 3, recent).otherwise(S.upper_middle(t))
    trend = F.when(n < 2, 0).when(change > 0.02, 1).when(change < -0.02, -1).otherwise(0)
    return g.select(
        "section_sport", "section_id", F.round(0.35 * recency + 0.30 * improvement + 0.20 * anomaly + 0.15 * engagement, 6).alias("relevance"), F.round(improvement, 6).alias("improvement"),
        F.round(anomaly, 6).alias("anomaly"), F.round(engagement, 6).alias("engagement"), F.col("n").alias("traversals"), "best", median_recent.alias("median_recent"), days.alias("days_since_last"),
        trend.alias("trend"), (F.abs(latest - F.col("best")) < 0.01).alias("latest_is_pr"), *(["best_time", "best_activity"] if best else []),
    )


def top_ranked(rank_rows: DataFrame, per_sport: int) -> DataFrame:
    """The most relevant sections of each sport."""
    w = Window.partitionBy("section_sport").orderBy(F.desc("relevance"), "section_id")
    return rank_rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_sport)


def calendar(lap_rows: DataFrame) -> DataFrame:
    """Year, month and direction: fastest lap and number of laps, from all laps with a time."""
    d = S.epoch_date(F.col("date"))
    rows = lap_rows.filter("lap_time > 0").select("section_id", F.year(d).alias("year"), F.month(d).alias("month"), S.direction_class(F.col("direction")).alias("side"), "lap_time", "activity_id", "date")
    best = F.min(F.struct("lap_time", "date", "activity_id"))
    return rows.groupBy("section_id", "year", "month", "side").agg(best["lap_time"].alias("best_time"), best["activity_id"].alias("best_activity"), F.count(F.lit(1)).alias("laps"))


def chart(lap_rows: DataFrame) -> DataFrame:
    """Every lap with its rank by speed in the section (1 is fastest) and the best rank of its activity."""
    w = Window.partitionBy("section_id")
    r = F.row_number().over(w.orderBy(F.desc("lap_pace"), "date", "activity_id", "start_index"))
    rows = lap_rows.filter("lap_pace > 0").select("section_id", "activity_id", "start_index", "lap_time", "lap_pace", r.alias("rank"))
    return rows.withColumn("best_rank", F.min("rank").over(Window.partitionBy("section_id", "activity_id")))


def efficiency_trend(lap_rows: DataFrame, hr: DataFrame) -> DataFrame:
    """Heart rate against pace of each section over time, with at least three plausible efforts.

    Ratios are heart rate by seconds a kilometre; improving where the slope is
    below -0.001 with five or more. effort_count counts rows before the pace
    filter.
    """
    rows = lap_rows.join(hr, ["section_id", "activity_id", "start_index"]).filter("lap_time > 0 and distance_meters > 0 and lap_hr > 0")
    rows = rows.withColumn("pace", F.col("lap_time") * 1000 / F.col("distance_meters")).withColumn("ok", F.col("pace").between(60, 1800))
    rows = rows.withColumn("day", (F.col("date") - F.min(F.when(F.col("ok"), F.col("date"))).over(Window.partitionBy("section_id"))) / 86400.0)
    y, x = F.when(F.col("ok"), F.col("lap_hr") / F.col("pace")), F.when(F.col("ok"), F.col("day"))
    g = rows.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("effort_count"), F.count(y).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(F.when(F.col("ok"), F.col("pace"))).alias("mean_pace"), F.max(x).alias("range_days")
    ).filter("n >= 3")
    slope = F.when(F.col("v") > 1e-12, F.col("c") / F.col("v")).otherwise(0.0)
    return g.select("section_id", "effort_count", F.round(slope, 8).alias("slope"), F.round(slope * F.col("mean_pace") * F.col("range_days"), 4).alias("hr_change"), ((slope < -0.001) & (F.col("n") >= 5)).alias("improving"))


def highlights(indicator_rows: DataFrame) -> DataFrame:
    """For each activity and section the strongest mark: a record, else the best trend."""
    best = F.max(F.struct((F.col("kind") == "section_pr").cast("int").alias("pr"), "value", "direction"))
    return indicator_rows.groupBy("activity_id", "section_id").agg(best["pr"].alias("is_pr"), best["value"].alias("trend"))


def missing_streams(traversals: DataFrame, streams: DataFrame) -> DataFrame:
    """Activities with traversals but no time stream."""
    return traversals.filter("lap_time is null").select("activity_id").distinct().join(streams.select("activity_id").distinct(), "activity_id", "left_anti")


def recent_records(records: DataFrame, metrics: DataFrame, visits: DataFrame, now: int, days: int = 7, least: int = 3) -> DataFrame:
    """Sections whose best was set in the last days and that have enough visits."""
    return (
        records.join(metrics.select(F.col("activity_id").alias("best_activity"), "date"), "best_activity").filter(F.col("date").between(now - days * 86400, now))
        .join(visits.filter(F.col("laps") >= least), "section_id").select("section_id", "best_activity", "best_time", "date", "laps")
    )


def backfilled_laps(traversals: DataFrame, times: DataFrame) -> DataFrame:
    """Times and paces for traversals without one, excluded ones too, from their activity's time stream (activity_id, index from 0, t).

    Only stretches that start after the first fix and end later are looked at;
    those with an end outside the stream, or without time between, are left out.
    """
    open_laps = traversals.filter("lap_time is null and start_index > 0 and end_index > start_index").select("section_id", "activity_id", "start_index", "end_index", "distance_meters")
    at = lambda t, i: times.select("activity_id", F.col("t").alias(t), F.col("index").alias(i))
    rows = open_laps.join(at("t0", "start_index"), ["activity_id", "start_index"]).join(at("t1", "end_index"), ["activity_id", "end_index"])
    lap = F.abs(F.col("t1") - F.col("t0")).cast("double")
    return rows.withColumn("lap_time", lap).filter("lap_time > 0").select("section_id", "activity_id", "start_index", "lap_time", F.round(F.col("distance_meters") / F.col("lap_time"), 6).alias("lap_pace"))
