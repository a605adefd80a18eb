"""Route performances, highlights and grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S
from stridelake.operators.graph import ensure_checkpoint_dir
from stridelake.operators.spatial import METRES_PER_DEGREE

EARTH_M = 6_371_000.0


def members(metrics: DataFrame) -> DataFrame:
    """Route members with speed (0 without a time) and direction class."""
    return metrics.select("route_id", "activity_id", "date", "moving_time", "distance", S.direction_class(F.col("direction")).alias("side"), S.speed(F.col("distance"), F.col("moving_time")).alias("speed"))


def performances(rows: DataFrame) -> DataFrame:
    """Each member with its rank by time in the route (times of 0 included) and the route's best (least positive) time."""
    w = Window.partitionBy("route_id")
    best = F.min(F.when(F.col("moving_time") > 0, F.col("moving_time"))).over(w)
    return rows.withColumn("rank", F.row_number().over(w.orderBy("moving_time", "date", "activity_id"))).withColumn("best_time", best)


def statistics(rows: DataFrame) -> DataFrame:
    """Per route and direction: members, best activity by time, mean of the positive speeds, mean distance, last date."""
    best = F.min(F.when(F.col("moving_time") > 0, F.struct("moving_time", "date", "activity_id")))
    return rows.groupBy("route_id", "side").agg(
        F.count(F.lit(1)).alias("members"), best["moving_time"].alias("best_time"), best["activity_id"].alias("best_activity"),
        F.round(F.avg(F.when(F.col("speed") > 0, F.col("speed"))), 9).alias("avg_speed"), F.round(F.avg("distance"), 7).alias("avg_distance"), F.max("date").alias("last_date"),
    )


def highlights(rows: DataFrame) -> DataFrame:
    """Trend of each member's speed against the mean of earlier ones (1 %), records, and the gap to the best time.

    Best and second-best are the two smallest times of the route and
    direction; ties fill both. Improvement is given only where the second is
    slower than the record.
    """
    w = Window.partitionBy("route_id", "side")
    order = w.orderBy("date", "activity_id")
    mean = F.avg("speed").over(order.rowsBetween(Window.unboundedPreceding, -1))
    two = F.row_number().over(w.orderBy("moving_time", "date", "activity_id"))
    r = rows.filter("moving_time > 0").withColumn("mean", mean).withColumn("k", two)
    r = r.withColumn("best", F.max(F.when(F.col("k") == 1, F.col("moving_time"))).over(w)).withColumn("second", F.max(F.when(F.col("k") == 2, F.col("moving_time"))).over(w))
    trend = F.when(F.col("mean").isNull(), 0).when(F.col("speed") > 1.01 * F.col("mean"), 1).when(F.col("speed") < 0.99 * F.col("mean"), -1).otherwise(0)
    pr = F.col("moving_time") == F.col("best")
    return r.select(
        "route_id", "side", "activity_id", trend.alias("trend"), pr.alias("is_pr"), (F.col("moving_time") - F.col("best")).alias("delta"),
        F.when(pr & (F.col("second") > F.col("moving_time")), F.col("second") - F.col("moving_time")).alias("improvement"),
    )


def summaries(metrics: DataFrame) -> DataFrame:
    """Groups of two or more with their sports."""
    return metrics.groupBy("route_id").agg(F.count(F.lit(1)).alias("activities"), F.concat_ws(",", F.array_sort(F.collect_set("sport_type"))).alias("sports"), F.min("activity_id").alias("representative")).filter("activities >= 2")


def match_percent(points: DataFrame, members: DataFrame, perfect_m: float, zero_m: float, block: int = 128, together: int = 1024) -> DataFrame:
    """Match percentage of each track (column pair) with its route's track, from the mean distance of each track's points to the other's nearest.

    points: track_id, seq from 1, lat, lng; members: track_id and route, the
    track that it is held against. The two one-way means are averaged and
    mapped linearly from perfect_m (100) to zero_m (0); a point with none
    within zero_m counts as zero_m away, which the mapping gives no credit for.
    Tracks meet as blocks of points whose latitudes come within reach, and a
    busy route's track is sent once for every `together` members. What a point
    is nearer than zero_m is its credit: the largest over all blocks of the
    other track, added up.
    """
    ensure_checkpoint_dir(points.sparkSession)
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = points.select("track_id", F.floor((F.col("seq") - 1) / block).alias("blk"), "lat", "lng")
    lists = rows.groupBy("track_id", "blk").agg(F.collect_list(known("lat")).alias("lats"), F.collect_list(known("lng")).alias("lngs"), F.min("lat").alias("south"), F.max("lat").alias("north")).checkpoint()
    pairs = members.select("track_id", "route").checkpoint()
    sizes = lists.groupBy("track_id").agg(F.sum(F.size("lats")).alias("n"), F.count(F.lit(1)).alias("blocks"))
    parts = pairs.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / together).alias("parts"))
    of = lambda p: lists.join(sizes.hint("merge"), "track_id").select(F.col("track_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("blk", "lats", "lngs", "south", "north", "blocks")))
    dealt = pairs.join(parts.hint("merge"), "route").select(F.col("track_id").alias("a_id"), "route", F.pmod(F.xxhash64("track_id"), F.col("parts")).alias("part"))
    a = of("a").join(dealt.hint("merge"), "a_id")
    b = of("b").join(parts.hint("merge"), F.col("b_id") == F.col("route")).drop("b_id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    reach = zero_m * 1.001 / METRES_PER_DEGREE
    met = a.join(b.hint("merge"), ["route", "part"]).filter((F.col("a_south") - reach <= F.col("b_north")) & (F.col("b_south") - reach <= F.col("a_north")))

    def credits(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                la, ga, lb, gb = (np.radians(np.asarray(c, float)) for c in (r.a_lats, r.a_lngs, r.b_lats, r.b_lngs))
                h = np.sin((lb - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb) * np.sin((gb - ga[:, None]) / 2) ** 2
                for axis, blk, others in ((1, r.a_blk, r.b_blocks), (0, r.b_blk, r.a_blocks)):
                    least = np.fmin.reduce(h, axis=axis)
                    gain = np.nan_to_num(np.maximum(zero_m - 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(least, 1.0))), 0.0))
                    if others == 1:  # no other block to wait for
                        out.append((r.a_id, axis, blk, -1, float(gain.sum())))
                    else:
                        out.extend((r.a_id, axis, blk, int(i), float(gain[i])) for i in np.nonzero(gain)[0])
            yield pd.DataFrame(out, columns=["pair", "side", "blk", "i", "credit"])

    kind = dict(pairs.dtypes)["track_id"]
    cut = met.select("a_id", "a_blk", "a_lats", "a_lngs", "a_blocks", "b_blk", "b_lats", "b_lngs", "b_blocks")
    won = cut.mapInPandas(credits, f"pair {kind}, side int, blk long, i int, credit double").groupBy("pair", "side", "blk", "i").agg(F.max("credit").alias("credit"))
    sums = won.groupBy("pair").agg(*(F.sum(F.when(F.col("side") == side, F.col("credit"))).alias(c) for c, side in (("ab", 1), ("ba", 0))))
    n = lambda name: sizes.select(F.col("track_id").alias(name), F.col("n").alias(f"n_{name}")).hint("merge")
    both = pairs.withColumnRenamed("track_id", "pair").join(n("pair"), "pair").join(n("route"), "route").join(sums.hint("merge"), "pair", "left")
    gain = (F.coalesce("ab", F.lit(0.0)) / F.col("n_pair") + F.coalesce("ba", F.lit(0.0)) / F.col("n_route")) / 2
    amd = zero_m - gain
    pct = F.greatest(F.least((zero_m - amd) / (zero_m - perfect_m) * 100, F.lit(100.0)), F.lit(0.0))
    return both.select("pair", F.round(amd, 3).alias("amd"), F.round(pct, 3).alias("match"))


def track_distances(points: DataFrame, groups: DataFrame, samples: int = 20) -> DataFrame:
    """(route_id, a, b, d) for each two tracks of a route: the mean distance of a's sampled points to the nearest of b's.

    points: track_id, seq from 1, lat, lng; groups: track_id, route_id. Both
    tracks are sampled at even steps, as many points as the shorter one has,
    `samples` at most. Pairs are those of a route, so a route of n tracks
    costs n squared times samples squared; only sampled points are joined.
    """
    sizes = points.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).join(groups, "track_id")
    pairs = sizes.toDF("a", "na", "route_id").join(sizes.toDF("b", "nb", "route_id"), "route_id").filter("a <> b").withColumn("k", F.least(F.lit(samples), "na", "nb"))
    step = {"a": F.expr("na div k"), "b": F.expr("nb div k")}
    pick = lambda side: (F.pmod(F.col("seq") - 1, step[side]) == 0) & ((F.col("seq") - 1) / step[side] < F.col("k"))
    left = pairs.join(points.withColumnRenamed("track_id", "a"), "a").filter(pick("a")).select("route_id", "a", "b", F.col("seq").alias("i"), F.col("lat").alias("la"), F.col("lng").alias("lo"))
    right = pairs.join(points.withColumnRenamed("track_id", "b"), "b").filter(pick("b")).select("a", "b", "lat", "lng")
    near = left.join(right, ["a", "b"]).groupBy("route_id", "a", "b", "i").agg(F.min(S.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lng"))).alias("d"))
    return near.groupBy("route_id", "a", "b").agg(F.avg("d").alias("d"))


def medoid(distances: DataFrame) -> DataFrame:
    """Member with the least summed distance to the others of its route (the smallest id of equal ones).

    distances: (route_id, a, b, d), each pair in both directions.
    """
    s = distances.groupBy("route_id", "a").agg(F.round(F.sum("d"), 3).alias("s"))
    best = F.min(F.struct("s", "a"))
    return s.groupBy("route_id").agg(best["a"].alias("medoid"), best["s"].alias("total"))


def _summed(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """For each position of a (lat, lng), the summed distance to the tracks of b (m, lats, lngs, all of k points): to the nearest point of each, times its m."""
    unit = lambda lat, lng: np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])
    x = unit(*(np.radians(a[c].to_numpy(float)) for c in ("lat", "lng")))[:, :, None]
    y, m = unit(*(np.radians(np.array(b[c].tolist(), float).T) for c in ("lats", "lngs"))), b["m"].to_numpy(float)
    out = np.empty(len(a))
    step = max(1, (1 << 16) // len(b))
    for lo in range(0, len(a), step):
        some, near = x[:, lo : lo + step], None
        for point in range(y.shape[1]):
            gap = some[0] - y[0, point]
            gap *= gap
            for axis in (1, 2):
                more = some[axis] - y[axis, point]
                more *= more
                gap += more
            near = gap if near is None else np.fmin(near, gap, out=near)  # chords, squared; points without a position count for nothing
        metres = 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(np.maximum(near, 0.0)) / 2, 1.0))
        out[lo : lo + step] = np.nan_to_num(metres) @ m
    return out


def _summed_distances(places: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """places (route_id, k, same, lat, lng) with f, the summed distance to the targets of their route, k and `same`.

    Blocks of places meet blocks of targets, each two in one group of a job, so
    a task holds two blocks; the sums of a place's groups are added up.
    """
    by = ["route_id", "k", "same"]
    places, targets = places.select(*by, "lat", "lng").checkpoint(), targets.select(*by, "kind", "m", "lats", "lngs")
    blocks = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    both = blocks(places, "xs").join(blocks(targets, "ys").hint("merge"), by).checkpoint()
    groups = both.agg(F.sum(F.col("xs") * F.col("ys"))).first()[0] or 0
    n = min(max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups), 10_000)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda c, *key: F.pmod(F.xxhash64(*key), F.col(c)).alias("x" if c == "xs" else "y")
    left = places.join(both.hint("merge"), by).select(*by, deal("xs", "lat", "lng"), every("ys").alias("y"), "lat", "lng")
    right = targets.join(both.hint("merge"), by).select(*by, every("xs").alias("x"), deal("ys", "kind"), "m", "lats", "lngs")
    # As many tasks as groups: a group is little to shuffle and much to compare.
    left, right = (df.toDF(*(f"{p}_{c}" if c in (*by, "x", "y") else c for c in df.columns)) for p, df in (("l", left), ("r", right)))
    cut = lambda df, p: df.repartition(n, *(f"{p}_{c}" for c in (*by, "x", "y"))).groupBy(*(f"{p}_{c}" for c in (*by, "x", "y")))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.rename(columns={f"l_{c}": c for c in by})
        return a[[*by, "lat", "lng"]].assign(f=_summed(a, b) if len(a) and len(b) else 0.0)

    kind = dict(places.dtypes)["route_id"]
    sums = cut(left, "l").cogroup(cut(right, "r")).applyInPandas(meet, f"route_id {kind}, k int, same boolean, lat double, lng double, f double")
    return sums.groupBy(*by, "lat", "lng").agg(F.sum("f").alias("f"))


#: Degrees of the cells by which far tracks are ruled out, and the kinds of a route from which on that pays.
CELLS, MANY = (0.002, 0.0005), 1024


def route_medoids(points: DataFrame, groups: DataFrame, samples: int = 20, block: int = 2048, many: int = MANY, cells: tuple[float, ...] = CELLS) -> DataFrame:
    """medoid() of track_distances() without a row for each pair: of each route of two tracks or more.

    Tracks with the same samples are one kind, which counts as often as it has
    tracks and stands for its smallest. A track's sum is the mean, over its
    points, of what a position's summed distance to all tracks is; and that
    differs between two positions by no more than their distance times the
    number of tracks. So, where a route has `many` kinds, sums are taken at one
    position of each cell first, and tracks go that cannot be the medoid by
    these bounds; what is left is compared point by point, and exactly. Without
    a track ruled out the work would still be quadratic in a route's kinds.
    """
    ensure_checkpoint_dir(points.sparkSession)
    sizes = points.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).join(groups.hint("merge"), "track_id").withColumn("own", F.least(F.lit(samples), "n").cast("int"))
    used = sizes.select("route_id", F.col("own").alias("k")).distinct()
    steps = sizes.join(used, "route_id").filter("k <= own").select("route_id", "track_id", "own", "k", F.expr("n div k").alias("step"))
    picked = steps.join(points.hint("merge"), "track_id").filter((F.pmod(F.col("seq") - 1, F.col("step")) == 0) & ((F.col("seq") - 1) / F.col("step") < F.col("k")))
    tracks = picked.groupBy("route_id", "track_id", "own").agg(F.array_sort(F.collect_list(F.struct("k", "seq", "lat", "lng"))).alias("s"))
    tracks = tracks.select("route_id", "track_id", "own", F.transform("s", lambda p: F.struct(p["k"], p["lat"], p["lng"]).cast("struct<k: int, lat: double, lng: double>")).alias("s"))
    kinds = tracks.groupBy("route_id", "own", F.sha2(F.to_json("s"), 256).alias("line")).agg(F.min("track_id").alias("kind"), F.count(F.lit(1)).alias("m"), F.first("s").alias("s"))
    totals = kinds.groupBy("route_id").agg(F.sum("m").alias("tracks"), F.count(F.lit(1)).alias("kinds")).filter("tracks > 1")
    kinds = kinds.join(totals.hint("merge"), "route_id").select("route_id", "own", "kind", "m", "kinds", "s").checkpoint()
    # Two tracks are compared at the smaller `own` of both: what is sampled at k meets tracks of that `own`, and at the own k larger ones, too.
    at_k = kinds.withColumn("k", F.explode(F.array_distinct("s.k"))).withColumn("s", F.filter("s", lambda p: p["k"] == F.col("k")))
    targets = at_k.withColumn("same", F.explode(F.when(F.col("k") == F.col("own"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    targets = targets.select("route_id", "k", "same", "kind", "m", F.col("s.lat").alias("lats"), F.col("s.lng").alias("lngs")).checkpoint()
    by = ["route_id", "k", "same"]
    reach = targets.groupBy(*by).agg(F.sum("m").alias("reach"))
    mine = at_k.select("route_id", "kind", "k", (F.col("k") < F.col("own")).alias("same"), F.explode("s").alias("p")).select(*by, "kind", "p.lat", "p.lng")
    mine = mine.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")).join(reach.hint("merge"), by).checkpoint()
    left = kinds.select("route_id", "kind", "kinds")
    most = left.agg(F.max("kinds")).first()[0] or 0
    for side in (*(cells if most >= many else ()), None):
        rows = mine.join(left.select("route_id", "kind").hint("merge"), ["route_id", "kind"])
        cell = lambda c: F.col(c) if side is None else F.floor(F.col(c) / side)  # noqa: B023, E731
        rows = rows.withColumn("cy", cell("lat")).withColumn("cx", cell("lng"))
        at = rows.groupBy(*by, "cy", "cx").agg(F.min(F.struct("lat", "lng")).alias("at")).select(*by, "cy", "cx", "at.lat", "at.lng").checkpoint()
        f = at.join(_summed_distances(at, targets, block).hint("merge"), [*by, "lat", "lng"]).select(*by, "cy", "cx", F.col("lat").alias("alat"), F.col("lng").alias("alng"), "f")
        off = F.lit(0.0) if side is None else S.haversine(F.col("lat"), F.col("lng"), F.col("alat"), F.col("alng")) * F.col("reach")
        means = rows.join(f.hint("merge"), [*by, "cy", "cx"]).groupBy("route_id", "kind", "k").agg(F.avg("f").alias("f"), F.avg(off).alias("off"))
        sums = means.groupBy("route_id", "kind").agg(F.sum("f").alias("f"), F.sum("off").alias("off"))
        sums = left.join(sums.hint("merge"), ["route_id", "kind"], "left").na.fill(0.0, ["f", "off"])
        if side is not None:
            # A little room for rounding.
            best = sums.groupBy("route_id").agg(F.min((F.col("f") + F.col("off")) * (1 + 1e-9) + 0.01).alias("best"))
            left = sums.join(best.hint("merge"), "route_id").filter((F.col("f") - F.col("off")) * (1 - 1e-9) <= F.col("best")).select("route_id", "kind", "kinds").checkpoint()
    return medoid(sums.select("route_id", F.col("kind").alias("a"), F.col("f").alias("d")))
