"""Activity patterns: k-means with silhouette selection per athlete and sport, and what follows from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S

MIN_K, MAX_K, MIN_SIZE, MIN_SILHOUETTE, ROUNDS, SHIFT = 2, 6, 6, 0.3, 100, 1e-6
MIN_SPAN_DAYS, MIN_PER_MONTH, SEASON_SHARE = 90, 0.3, 0.6
# Multiplier and increment of the generator that seeds the centres.
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407
FEATURES = ["f_dow", "f_duration", "f_load", "f_distance"]


def normalised(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Weekday over six, and duration, load and distance scaled to 0..1 within each group (one half where constant)."""
    w = Window.partitionBy(*by)

    def scaled(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    dow = F.weekday(S.epoch_date(F.col("date")))
    return metrics.withColumn("dow", dow).select(
        *by, "activity_id", "date", "dow", "moving_time", "distance", "training_load",
        (F.col("dow") / 6.0).alias("f_dow"), scaled("moving_time").alias("f_duration"), scaled("training_load").alias("f_load"), scaled("distance").alias("f_distance"),
    )


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def seed_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Centres spread by squared distance, chosen with a fixed generator instead of chance."""
    n = len(x)
    picked = [int(np.floor(x[:, 0] * 1000).astype(np.int64).sum()) % n]
    near = np.full(n, np.inf)
    while len(picked) < k:
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
        total = near.sum()
        if total < 1e-12:
            picked.append(len(picked) % n)
            continue
        draw = (LCG_A * len(picked) + LCG_C) % 2**64 % n
        over = np.nonzero(np.cumsum(near) >= draw / n * total)[0]
        picked.append(int(over[0]) if len(over) else 0)
    return x[picked].copy()


def k_means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds until the centres' squared shift is under SHIFT; an empty cluster's centre becomes zero."""
    centres = seed_centres(x, k)
    for _ in range(ROUNDS):
        label = _squared(x, centres).argmin(1)
        counts = np.bincount(label, minlength=k)
        sums = np.stack([np.bincount(label, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        nxt = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], 0.0)
        shift = ((nxt - centres) ** 2).sum()
        centres = nxt
        if shift < SHIFT:
            break
    return centres, label


def silhouettes(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Silhouette of each row, in blocks of rows; 0 for rows alone in their cluster."""
    counts = np.bincount(label, minlength=k)
    out = np.zeros(len(x))
    for lo in range(0, len(x), 512):
        d = np.sqrt(_squared(x[lo : lo + 512], x))
        sums = np.stack([d[:, label == c].sum(1) for c in range(k)], 1)
        own = label[lo : lo + 512]
        at = np.arange(len(own))
        a = sums[at, own] / np.maximum(counts[own] - 1, 1)
        others = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
        others[at, own] = np.inf
        b = others.min(1)
        b = np.where(np.isfinite(b), b, a)
        s = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
        out[lo : lo + 512] = np.where(counts[own] > 1, s, 0.0)
    return out


def cluster_group(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels and silhouettes for the k with the best mean silhouette; None if too few rows or no k reaches the least."""
    best = None
    for k in range(MIN_K, min(MAX_K, len(x) // MIN_SIZE) + 1):
        _, label = k_means(x, k)
        s = silhouettes(x, label, k)
        if best is None or s.mean() > best[0]:
            best = (s.mean(), label, s)
    return None if best is None or best[0] < MIN_SILHOUETTE else best[1:]


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, column by column."""
    out = (a[:, 0] - b[:, 0]) ** 2
    for d in range(1, a.shape[1]):
        out += (a[:, d] - b[:, d]) ** 2
    return out


def _k_means_of(x: np.ndarray, sizes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Labels of k_means() for many groups at once, from the first centres of each; rows of a group are together."""
    label, k = np.zeros(len(x), int), centres.shape[1]
    group = np.repeat(np.arange(len(sizes)), sizes)
    rows, live = np.arange(len(x)), np.arange(len(sizes))  # of groups that still move
    for _ in range(ROUNDS):
        at = np.searchsorted(live, group[rows])
        some, c = x[rows], centres[live]
        gap = np.stack([_gaps(some, c[at, j]) for j in range(k)], 1)
        label[rows] = gap.argmin(1)
        cell = at * k + label[rows]
        counts = np.bincount(cell, minlength=len(live) * k).reshape(-1, k)
        sums = np.stack([np.bincount(cell, weights=some[:, d], minlength=len(live) * k) for d in range(x.shape[1])], 1).reshape(-1, k, x.shape[1])
        nxt = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], 0.0)
        shift = ((nxt - c) ** 2).sum((1, 2))
        centres[live] = nxt
        moving = shift >= SHIFT
        rows, live = rows[moving[at]], live[moving]
        if not len(live):
            break
    return label


def cluster_groups(x: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """cluster_group() of many small groups at once: distances are made once, rounds and sums are over the rows of all."""
    ends = np.cumsum(sizes)
    parts = [slice(e - n, e) for e, n in zip(ends, sizes)]
    # All pairs of rows within a group, row by row.
    own = np.repeat(np.arange(len(x)), np.repeat(sizes, sizes))
    other = np.concatenate([np.tile(np.arange(p.start, p.stop), p.stop - p.start) for p in parts])
    d = np.sqrt(_gaps(x[own], x[other]))
    # A centre's choice does not depend on how many follow it.
    seeds = [seed_centres(x[p], min(MAX_K, (p.stop - p.start) // MIN_SIZE)) for p in parts]
    best: list = [None] * len(sizes)
    for k in range(MIN_K, MAX_K + 1):
        able = np.nonzero(sizes // MIN_SIZE >= k)[0]
        if not len(able):
            break
        rows = np.concatenate([np.arange(parts[g].start, parts[g].stop) for g in able])
        label = np.zeros(len(x), int)
        label[rows] = _k_means_of(x[rows], sizes[able], np.stack([seeds[g][:k] for g in able]))
        group = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(group * k + label, minlength=len(sizes) * k).reshape(-1, k)[group]
        sums = np.bincount(own * k + label[other], weights=d, minlength=len(x) * k).reshape(-1, k)
        at = np.arange(len(x))
        a = sums[at, label] / np.maximum(counts[at, label] - 1, 1)
        means = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
        means[at, label] = np.inf
        b = means.min(1)
        b = np.where(np.isfinite(b), b, a)
        s = np.where(counts[at, label] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        for g in able.tolist():
            mean = s[parts[g]].mean()
            if best[g] is None or mean > best[g][0]:
                best[g] = (mean, label[parts[g]].copy(), s[parts[g]].copy())
    return [None if b is None or b[0] < MIN_SILHOUETTE else b[1:] for b in best]


#: Pairs of rows that are compared at once; a group with more is clustered alone, by blocks of rows.
PAIRS = 500_000
#: Buckets that each partition's groups are cut into.
BUCKETS = 64


def clusters(features: DataFrame, by: list[str]) -> DataFrame:
    """Cluster and silhouette of each activity. A group is one athlete's history in one sport, which bounds its size.

    Groups come to the workers in buckets, a 64th of a partition each, and
    are clustered many at a time.
    """
    kinds = dict(features.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", activity_id bigint, cluster int, silhouette double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_g=pdf.groupby(by, dropna=False, sort=False).ngroup()).sort_values(["_g", "activity_id"], ignore_index=True)
        sizes, x = np.bincount(pdf["_g"]), pdf[FEATURES].to_numpy(float)
        found, group, start = [], 0, 0
        while group < len(sizes):
            last, pairs = group + 1, int(sizes[group]) ** 2
            while last < len(sizes) and pairs + int(sizes[last]) ** 2 <= PAIRS:
                pairs += int(sizes[last]) ** 2
                last += 1
            end = start + int(sizes[group:last].sum())
            found += cluster_groups(x[start:end], sizes[group:last]) if pairs <= PAIRS else [cluster_group(x[start:end])]
            group, start = last, end
        keep = np.repeat([f is not None for f in found], sizes)
        joined = lambda i, kind: np.concatenate([np.zeros(0), *(f[i] for f in found if f is not None)]).astype(kind)
        return pdf.loc[keep, [*by, "activity_id"]].assign(cluster=joined(0, "int32"), silhouette=joined(1, float))

    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS
    bucket = F.pmod(F.xxhash64(*by), F.lit(n)).alias("_bucket")
    return features.select(*by, "activity_id", *FEATURES, bucket).groupBy("_bucket").applyInPandas(run, schema)


def mode_day(rows: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent weekday; the latest of equally frequent ones."""
    return rows.groupBy(*by, "dow").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.max(F.struct("c", "dow"))["dow"].alias("primary_day"))


def patterns(features: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Clusters that pass the gates, with their day, season, frequency, means and confidence.

    Gates: members, days spanned, mean silhouette and members a month. The
    season is the one with over 60 % of the members, else "all" where three or
    more occur, else the most frequent one.
    """
    key = [*by, "cluster"]
    rows = features.join(labels.select("activity_id", "cluster", "silhouette"), "activity_id").withColumn("season", S.season(S.epoch_date(F.col("date"))))
    # All of a cluster in one aggregation, so that the labels are made once.
    counts = lambda c, values: [F.struct(F.count(F.when(F.col(c).eqNullSafe(F.lit(v)), 1)).alias("c"), F.lit(v).cast(dict(rows.dtypes)[c]).alias(c)) for v in values]
    seasons, days = counts("season", ["winter", "spring", "summer", "autumn"]), counts("dow", [None, *range(7)])
    g = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("members"), F.floor((F.max("date") - F.min("date")) / 86400).alias("span_days"), F.avg("silhouette").alias("silhouette"), F.floor(F.avg("moving_time")).alias("avg_duration"),
        F.avg("distance").alias("avg_distance"), F.avg("training_load").alias("avg_load"), F.size(F.filter(F.array(*seasons), lambda s: s["c"] > 0)).alias("seasons"), F.array_max(F.array(*seasons)).alias("top"), F.array_max(F.array(*days)).alias("d"),
    )
    g = g.withColumn("per_month", F.col("members") / (F.greatest(F.col("span_days"), F.lit(1)) / 30.44))
    g = g.filter((F.col("members") >= MIN_SIZE) & (F.col("span_days") >= MIN_SPAN_DAYS) & (F.col("silhouette") >= MIN_SILHOUETTE) & (F.col("per_month") >= MIN_PER_MONTH))
    share = F.col("top.c") / F.col("members")
    label = F.when(share > SEASON_SHARE, F.col("top.season")).when(F.col("seasons") >= 3, "all").otherwise(F.col("top.season"))
    confidence = 0.3 * F.least(F.col("members") / 20, F.lit(1.0)) + 0.3 * F.col("silhouette") + 0.2 * F.least(F.col("per_month") / 4, F.lit(1.0)) + 0.2 * F.col("d.c") / F.col("members")
    return g.select(
        *key, "members", "span_days", F.round("silhouette", 6).alias("silhouette"), "avg_duration", F.round("avg_distance", 3).alias("avg_distance"), F.round("avg_load", 4).alias("avg_load"),
        F.round("per_month", 4).alias("per_month"), label.alias("season"), F.col("d.dow").alias("primary_day"), F.round(confidence, 6).alias("confidence"),
    )


def pattern_today(pattern_rows: DataFrame, by: list[str], dow: int, season: str) -> DataFrame:
    """The most confident pattern of each group for a weekday (one day off counts, around the week's end too) and season."""
    gap = F.abs(F.col("primary_day") - dow)
    ok = (F.least(gap, 7 - gap) <= 1) & F.col("season").isin(season, "all")
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), "cluster")
    return pattern_rows.filter(ok).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def pattern_sections(labels: DataFrame, laps: DataFrame, by: list[str]) -> DataFrame:
    """Sections that at least half of a cluster's activities visit: appearances, best time, median of the newest five, trend.

    The trend compares halves of the times, newest first, by 3 % from four times on.
    """
    key = [*by, "cluster"]
    sized = labels.select("activity_id", *key, F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("members"))
    rows = sized.join(laps.filter("lap_time > 0").select("activity_id", "section_id", "lap_time", F.col("date").alias("lap_date"), "start_index"), "activity_id")
    rows = newest_first(rows, [*key, "section_id"], ["lap_date", "activity_id", "start_index"])
    five = F.collect_list(F.when(F.col("k") <= 5, F.col("lap_time")))
    g = rows.groupBy(*key, "section_id").agg(F.countDistinct("activity_id").alias("appearances"), F.min("lap_time").alias("best"), five.alias("five"), half_trend("lap_time").alias("trend"), F.first("members").alias("members"))
    g = g.filter("appearances >= 0.5 * members")
    return g.select(*key, "section_id", "appearances", "best", S.upper_middle(F.col("five")).alias("median_recent"), "trend")


def newest_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with their place k from the newest on, and the number n of rows of the group."""
    w = Window.partitionBy(*by)
    return rows.withColumn("k", F.row_number().over(w.orderBy(*(F.desc(c) for c in order)))).withColumn("n", F.count(F.lit(1)).over(w))


def half_trend(value: str) -> F.Column:
    """An aggregate over newest_first(): 1 where the newer half is over 3 % faster than the older, -1 where slower; 0 under four values."""
    newer = F.col("k") <= F.floor(F.col("n") / 2)
    new, old = F.avg(F.when(newer, F.col(value))), F.avg(F.when(~newer, F.col(value)))
    return F.when(F.count(F.lit(1)) < 4, 0).when(new < old * 0.97, 1).when(new > old * 1.03, -1).otherwise(0)
