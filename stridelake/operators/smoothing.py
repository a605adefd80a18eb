"""Moving averages, local-linear smoothing with a band, scatter and lane positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centred_average(df: DataFrame, by: list[str], day: str, value: str, width: int) -> DataFrame:
    """Mean over the days within half of width on either side; days without rows add nothing."""
    w = Window.partitionBy(*by).orderBy(day).rangeBetween(-(width // 2), width // 2)
    return df.select(*by, day, F.round(F.avg(value).over(w), 9).alias("smoothed"))


#: Rows up to which a group is one array, which is fitted as a whole.
LISTED = 256


def _fitted(outputs: int):
    """Places, fits and deviations of groups, of which each has one array of x and one of y; 64 groups at a time."""

    @F.arrow_udf("struct<at: array<double>, fit: array<double>, sigma: array<double>>")
    def fits(x0: pa.Array, x1: pa.Array, n: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        lows, spans = x0.to_numpy(), x1.to_numpy() - x0.to_numpy()
        widths = spans / np.maximum(3.0, np.sqrt(n.to_numpy()))
        sizes = xs.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        x, y = xs.flatten().to_numpy(), ys.flatten().to_numpy()
        out = np.empty((3, len(sizes), outputs))
        for lo in range(0, len(sizes), 64):
            hi = min(lo + 64, len(sizes))
            group = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            at = lows[lo:hi, None] + spans[lo:hi, None] * np.arange(outputs) / float(outputs - 1)
            u, v = x[ends[lo] : ends[hi], None] - at[group], y[ends[lo] : ends[hi], None]
            w = np.exp(-0.5 * (u / widths[lo:hi][group][:, None]) ** 2)
            s0, s1, s2, t0, t1, q = (np.add.reduceat(m, ends[lo:hi] - ends[lo], axis=0) for m in (w, w * u, w * u * u, w * v, w * u * v, w * v * v))
            det = s0 * s2 - s1 * s1
            sure = np.abs(det) > 1e-12
            fit = np.where(sure, (s2 * t0 - s1 * t1) / np.where(sure, det, 1.0), t0 / s0)
            out[:, lo:hi] = at, fit, np.sqrt(np.maximum(q / s0 - 2 * fit * t0 / s0 + fit * fit, 0.0))
        cuts = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * outputs)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(m.ravel())) for m in out], ["at", "fit", "sigma"])

    return fits


def local_linear(df: DataFrame, by: list[str], x: str, y: str, outputs: int = 200) -> DataFrame:
    """Gaussian-kernel local-linear fit at evenly spaced places of each group, with the weighted deviation around it and the least and largest y (lo, hi).

    The bandwidth is the span over max(3, sqrt(n)). A group of at most LISTED
    rows is one array and is fitted at once, so only its rows are shuffled. In
    a larger one every row adds its weighted moments to each place; the sums
    combine map-side, so a group of any size is `outputs` rows a task, fewer
    than it has rows. The deviation follows from the moments.
    """
    g = df.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.count(F.lit(1)).alias("n"), F.count(y).alias("ny"), F.min(y).alias("lo"), F.max(y).alias("hi")).filter("x1 > x0")
    every = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).join(g.hint("merge"), by)
    few = F.col("n") <= LISTED
    of = ["x0", "x1", "n", "ny", "lo", "hi"]
    listed = every.filter(few).groupBy(*by).agg(*(F.first(c).alias(c) for c in of), F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_x", F.coalesce("_y", F.lit(0.0)).alias("_y")))).alias("_l"))
    some = listed.withColumn("_f", _fitted(outputs)("x0", "x1", "n", F.col("_l._x"), F.col("_l._y"))).withColumn("_f", F.arrays_zip("_f.at", "_f.fit", "_f.sigma"))
    some = some.select(*by, "lo", "hi", "ny", F.posexplode("_f").alias("i", "_f")).select(*by, "i", "_f.at", F.when(F.col("ny") > 0, F.col("_f.fit")).alias("fit"), F.when(F.col("ny") > 0, F.col("_f.sigma")).alias("sigma"), "lo", "hi")
    rows = every.filter(~few).withColumn("i", F.explode(F.expr(f"sequence(0, {outputs - 1})")))
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / float(outputs - 1)
    h = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(3.0), F.sqrt("n"))
    u, v = F.col("_x") - F.col("at"), F.col("_y")
    rows = rows.withColumn("at", at).withColumn("w", F.exp(-0.5 * F.pow((F.col("_x") - at) / h, 2)))
    m = rows.groupBy(*by, "i").agg(
        F.first("at").alias("at"), F.sum("w").alias("s0"), F.sum(F.col("w") * u).alias("s1"), F.sum(F.col("w") * u * u).alias("s2"), F.sum(F.col("w") * v).alias("t0"), F.sum(F.col("w") * u * v).alias("t1"), F.sum(F.col("w") * v * v).alias("q"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(F.abs(det) > 1e-12, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0"))
    var = F.greatest(F.col("q") / F.col("s0") - 2 * fit * F.col("t0") / F.col("s0") + fit * fit, F.lit(0.0))
    return some.unionByName(m.select(*by, "i", "at", fit.alias("fit"), F.sqrt(var).alias("sigma"), "lo", "hi"))


def clamped_band(fit: DataFrame, by: list[str], pad: float = 0.15) -> DataFrame:
    """The fit's one-sigma band, kept within the data's range (lo, hi) widened by pad."""
    room = (F.col("hi") - F.col("lo")) * pad
    clamp = lambda c: F.greatest(F.least(c, F.col("hi") + room), F.col("lo") - room)
    return fit.select(*by, "i", "fit", clamp(F.col("fit") - F.col("sigma")).alias("low"), clamp(F.col("fit") + F.col("sigma")).alias("high"))


def scatter_positions(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """x between 0.02 and 0.98 by date within the group; one half where all dates are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(date).over(w), F.max(date).over(w)
    return df.withColumn("x", F.round(F.when(hi > lo, 0.02 + 0.96 * (F.col(date) - lo) / (hi - lo)).otherwise(0.5), 9))


def lanes(df: DataFrame, by: list[str], lane: str, value: str) -> DataFrame:
    """Per lane: best (largest) value, range and padding of 20 % of the range, at least 0.5."""
    return df.groupBy(*by, lane).agg(F.max(value).alias("best"), F.min(value).alias("low"), F.count(F.lit(1)).alias("points"), F.round(F.greatest((F.max(value) - F.min(value)) * 0.2, F.lit(0.5)), 9).alias("padding"))
