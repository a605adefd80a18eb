"""Period, zone and day aggregates, wellness series, threshold histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S

POWER_SHARES = [0.30, 0.25, 0.18, 0.12, 0.08, 0.05, 0.02]
HR_SHARES = [0.40, 0.28, 0.17, 0.10, 0.05]
#: Sports whose sessions carry a cycling threshold power.
FTP_SPORTS = ["Ride", "VirtualRide", "MountainBikeRide", "GravelRide", "EBikeRide", "TrackRide", "Cyclocross", "Handcycle", "Velomobile"]


def period_stats(metrics: DataFrame, start: int, end: int) -> DataFrame:
    """Count and sums of the activities from start to end, both included; zeros for an empty period."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return metrics.filter(F.col("date").between(start, end)).agg(
        F.count(F.lit(1)).alias("count"), zero("moving_time").cast("long").alias("moving_time"),
        F.round(zero("distance"), 2).alias("distance"), F.round(zero("training_load"), 3).alias("training_load"),
    )


def zone_seconds(metrics: DataFrame, kind: str) -> DataFrame:
    """Activity, zone number and seconds; an unknown kind has no rows."""
    shares = {"power": POWER_SHARES, "hr": HR_SHARES}.get(kind, [])
    zones = F.array(*(F.floor(F.col("moving_time") * s) for s in shares)).cast("array<bigint>")
    return metrics.select("activity_id", "sport_type", F.posexplode(zones).alias("zone", "seconds"))


def zone_distribution(metrics: DataFrame, sport: str, kind: str) -> DataFrame:
    """Seconds in each zone over a sport's activities, with rounded percentages (null where the sum is 0)."""
    total = F.sum("seconds").over(Window.partitionBy())
    return (
        zone_seconds(metrics.filter(F.col("sport_type") == sport), kind).groupBy("zone").agg(F.sum("seconds").alias("seconds"))
        .select((F.col("zone") + 1).cast("int").alias("zone"), "seconds", F.when(total > 0, F.floor(100.0 * F.col("seconds") / total + 0.5)).cast("long").alias("percent"))
    )


def dominant_zone(distribution: DataFrame) -> DataFrame:
    """The zone with the largest percentage (the lowest of equal ones); null if none has any."""
    best = F.max(F.when(F.col("percent") > 0, F.struct("percent", (-F.col("zone")).alias("z"))))
    return distribution.agg(best.alias("b")).select((-F.col("b.z")).alias("zone"), F.col("b.percent").alias("percent"))


def stream_zones(points: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Samples in each zone, a value belonging to the first zone with lower <= value < upper."""
    zone = F.lit(None).cast("int")
    for i in reversed(range(len(bounds) - 1)):
        zone = F.when((F.col(value) >= bounds[i]) & (F.col(value) < bounds[i + 1]), i + 1).otherwise(zone)
    return points.select(zone.alias("zone")).filter("zone is not null").groupBy("zone").agg(F.count(F.lit(1)).alias("samples"))


def intensity(seconds: Column) -> Column:
    return F.when(seconds > 7200, 4).when(seconds > 5400, 3).when(seconds > 3600, 2).when(seconds > 0, 1).otherwise(0)


def day_heatmap(metrics: DataFrame) -> DataFrame:
    """A row for each UTC day with activities: intensity class of the longest, its time, and their number."""
    longest = F.max("moving_time")
    return metrics.groupBy(F.date_format(S.epoch_date(F.col("date")), "yyyy-MM-dd").alias("day")).agg(
        intensity(longest).alias("intensity"), longest.alias("max_duration"), F.count(F.lit(1)).alias("activity_count")
    )


def bounds_union(activities: DataFrame, metrics: DataFrame, start: int, end: int, sports: list[str]) -> DataFrame:
    """Smallest box around the boxes of a period's activities of some sports."""
    keys = metrics.filter(F.col("date").between(start, end) & F.col("sport_type").isin(sports)).select("activity_id")
    return activities.join(keys, "activity_id").agg(
        F.round(F.min("min_lat"), 6).alias("min_lat"), F.round(F.max("max_lat"), 6).alias("max_lat"), F.round(F.min("min_lng"), 6).alias("min_lng"), F.round(F.max("max_lng"), 6).alias("max_lng")
    )


def threshold_change(metrics: DataFrame, value: str, sports: list[str], last: int = 20, gap: float = 0.0) -> DataFrame:
    """Latest value and the most recent one before it that differs by more than gap, among the last rows."""
    rows = metrics.filter(F.col(value).isNotNull() & F.col("sport_type").isin(sports)).orderBy(F.desc("date"), F.desc("activity_id")).limit(last)
    latest = rows.agg(F.max_by(value, F.struct("date", "activity_id")).alias("latest"), F.max(F.struct("date", "activity_id"))["date"].alias("latest_date"))
    other = rows.join(F.broadcast(latest.select("latest")), F.abs(F.col(value) - F.col("latest")) > gap).agg(
        F.max_by(value, F.struct("date", "activity_id")).alias("previous"), F.max(F.struct("date", "activity_id"))["date"].alias("previous_date")
    )
    return latest.join(other)


def pace_milestone(change: DataFrame, metres: int) -> DataFrame:
    """Of a change of speed (latest, previous): seconds gained over so many metres and percent, if it is a gain in both once rounded."""
    better = change.filter("latest > 0 and previous > 0 and latest > previous")
    rows = better.select(
        "latest", "previous", S.round_half_up(metres / F.col("previous") - metres / F.col("latest")).alias("gain_secs"), S.round_half_up((F.col("latest") - F.col("previous")) / F.col("previous") * 100).alias("gain_percent")
    )
    return rows.filter("gain_secs > 0 and gain_percent > 0")


def heart_series(wellness: DataFrame, days: int) -> DataFrame:
    """The last `days` rows, oldest first, numbered; fitness, fatigue and form with nulls as 0."""
    rows = wellness.orderBy(F.desc("date")).limit(days)
    ctl, atl = F.coalesce("ctl", F.lit(0.0)), F.coalesce("atl", F.lit(0.0))
    return rows.select(
        F.row_number().over(Window.orderBy("date")).alias("n"), "date", F.round(ctl).cast("long").alias("fitness"), F.round(atl).cast("long").alias("fatigue"),
        F.round(ctl - atl).cast("long").alias("form"), (S.round_half_up(ctl) - S.round_half_up(atl)).cast("long").alias("form_rounded_parts"), S.form_zone(ctl - atl).alias("zone"),
    )


def forward_filled(wellness: DataFrame, value: str, days: int) -> DataFrame:
    """Rounded values of the last rows with gaps filled from before, leading gaps from the first value; no rows if all are null."""
    rows = wellness.orderBy(F.desc("date")).limit(days)
    w = Window.orderBy("date")
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lead = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("date", F.round(F.coalesce(back, lead)).cast("long").alias("filled")).filter("filled is not null")


def hrv_trend(wellness: DataFrame, days: int) -> DataFrame:
    """Mean, latest, halves and trend of the positive values among the last rows; no row for fewer than five.

    Up or down where the later half's mean is 2 % away from the earlier one's,
    down also where the last three values fall.
    """
    rows = wellness.orderBy(F.desc("date")).limit(days).filter("hrv > 0")
    v = F.col("v")
    n = F.size(v)
    half = F.floor(n / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    out = rows.agg(F.array_sort(F.collect_list(F.struct("date", "hrv"))).alias("s")).select(F.col("s.hrv").alias("v")).filter(n >= 5)
    first, second = mean(F.slice(v, 1, half)), mean(F.slice(v, half + 1, n - half))
    falls = (F.get(v, n - 1) < F.get(v, n - 2)) & (F.get(v, n - 2) < F.get(v, n - 3))
    trend = F.when((second > first * 1.02) & ~falls, "improving").when((second < first * 0.98) | falls, "declining").otherwise("stable")
    return out.select(
        n.alias("points"), F.round(mean(v), 4).alias("average"), F.round(F.get(v, n - 1), 4).alias("latest"), F.round(first, 4).alias("first_half"), F.round(second, 4).alias("second_half"), trend.alias("trend")
    )


def regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept by group; a degenerate group has slope 0 and the mean as intercept."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy")
    )
    slope = F.when(F.col("vx") > 1e-12, F.col("cxy") / F.col("vx")).otherwise(0.0)
    return g.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def decoupling(points: DataFrame, by: str, power: str, hr: str) -> DataFrame:
    """Percent by which power / heart rate falls from the first to the second half of a series; good below 5."""
    w = Window.partitionBy(by).orderBy("t", "point_id")
    rows = points.filter((F.col(power) > 0) & (F.col(hr) > 0)).withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by))).filter("n >= 4")
    first = F.col("i") <= F.floor(F.col("n") / 2)
    ef = lambda c: F.avg(F.when(c, F.col(power))) / F.avg(F.when(c, F.col(hr)))
    g = rows.groupBy(by).agg(ef(first).alias("a"), ef(~first).alias("b"))
    pct = F.round((F.col("a") - F.col("b")) / F.col("a") * 100, 4)
    return g.select(by, pct.alias("decoupling"), (pct < 5).alias("good"))


def even_steps(df: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """About `keep` rows of each group (one person's history) at even steps; first and last stay."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.floor(F.col("_n") / keep), F.lit(1))
    return r.filter(((F.col("_i") - 1) % step == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")
