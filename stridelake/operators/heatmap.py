"""Heatmap tiles: coverage, pixel counts, blur, exposure and PNG files."""

from __future__ import annotations

import itertools
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalar as S

SIZE, BLUR_TO_ZOOM, SATURATION, FINEST = 512, 9, 65_535, 17
# Stroke width in pixels and intensity of a pass, up to and including a zoom.
WIDTHS = [(6, 6.0), (8, 5.0), (10, 4.0), (12, 3.2), (14, 2.6), (15, 2.1), (16, 1.7), (FINEST, 1.4)]
INTENSITIES = [(8, 18.0), (11, 16.0), (14, 14.0), (16, 12.0), (FINEST, 10.0)]
#: Colour stops (share of full exposure, red, green, blue, alpha), from transparent over orange to white.
GRADIENT = [(0.0, 120, 20, 0, 0), (0.15, 180, 50, 0, 140), (0.5, 252, 100, 20, 210), (0.8, 255, 190, 90, 240), (1.0, 255, 255, 240, 255)]
#: Values of one sequence() at most; longer stretches are cut first, so no array grows with a segment's length.
STRETCH = 4096


def of_zoom(steps: list[tuple[int, float]], zoom: int) -> float:
    return next(v for z, v in steps if zoom <= z)


def _along(low: str, high: str, name: str) -> list[tuple[str, F.Column]]:
    """Two columns to add in turn: stretches of the whole numbers from low to high, and the numbers themselves."""
    return [
        ("_from", F.explode(F.expr(f"sequence({low}, {high}, {STRETCH})"))),
        (name, F.explode(F.expr(f"sequence(_from, least(_from + {STRETCH - 1}, {high}))"))),
    ]


def explode_range(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each whole number from column low to column high."""
    for column, value in _along(low, high, name):
        df = df.withColumn(column, value)
    return df.drop("_from")


def point_tiles(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Distinct tiles of each track's points at each zoom, from those at the finest one."""
    top = max(zooms)
    return parents(points.dropna(subset=["lat", "lng"]).select("track_id", S.tile_x(F.col("lng"), top).alias("x"), S.tile_y(F.col("lat"), top).alias("y")), top, zooms)


def _spread(c: F.Column) -> F.Column:
    """A whole number's lowest 24 bits, with a free bit after each."""
    out = c.bitwiseAND(F.lit(1))
    for bit in range(1, 24):
        out = out.bitwiseOR(F.shiftleft(c.bitwiseAND(F.lit(1 << bit)), bit))
    return out


def parents(fine: DataFrame, top: int, zooms: list[int]) -> DataFrame:
    """Distinct tiles at each zoom that hold the tiles (track_id, x, y; repeats are allowed) of zoom top.

    A track's tiles are put in the order of their interleaved coordinates,
    where the tiles within a coarser one are neighbours. So a row brings
    exactly the zooms at which it differs from the one before, and no tile
    is made twice. One sort by track; nothing is shuffled where the rows are
    dealt by track already.
    """
    rows = fine.withColumn("_m", _spread(F.col("x")).bitwiseOR(F.shiftleft(_spread(F.col("y")), 1)))
    rows = rows.withColumn("_d", F.col("_m").bitwiseXOR(F.lag("_m").over(Window.partitionBy("track_id").orderBy("_m")))).filter("_d is null or _d <> 0")
    # Half the place of the highest bit that differs is the number of zooms, from the finest one, that differ with it.
    first = F.when(F.col("_d").isNull(), min(zooms)).otherwise(F.greatest(top - F.floor(F.log2("_d") / 2).cast("int"), F.lit(min(zooms))))
    z = rows.withColumn("z", F.explode(F.sequence(first, F.lit(top))))
    if set(zooms) != set(range(min(zooms), top + 1)):
        z = z.filter(F.col("z").isin(zooms))
    return z.select("track_id", "z", F.expr(f"shiftright(x, {top} - z)").alias("x"), F.expr(f"shiftright(y, {top} - z)").alias("y"))


def _steps(points: DataFrame, scale: float, *more: F.Column) -> DataFrame:
    """Each point on a square world map of `scale` a side, with the next one of its track (qx, qy) and further columns."""
    w = Window.partitionBy("track_id").orderBy("seq")
    r = F.radians(F.greatest(F.least(F.col("lat"), F.lit(85.051129)), F.lit(-85.051129)))
    px = points.select("track_id", "seq", ((F.col("lng") + 180) / 360 * scale).alias("px"), ((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * scale).alias("py"), *more)
    return px.select("*", F.lead("px").over(w).alias("qx"), F.lead("py").over(w).alias("qy"))


def _whole() -> F.Column:
    """Steps with both ends known."""
    ends = ("px", "py", "qx", "qy")
    known = F.col("track_id").isNotNull() & F.col("seq").isNotNull()
    for c in ends:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    return known


def segments(points: DataFrame, scale: float) -> DataFrame:
    """Consecutive points of each track on a square world map of `scale` a side; a missing coordinate breaks the line."""
    return _steps(points, scale).filter(_whole())


def line_tiles(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Distinct tiles that each track's points and the lines between them touch, at each zoom.

    Swept at the finest zoom, column of tiles by column: a line enters and
    leaves each at known heights. A coarser tile is touched exactly if one of
    its fine ones is. Fixes and lines come from one pass over the track, so
    all its tiles are made, and told apart, in the task that holds it.
    """
    top = max(zooms)
    s = _steps(points, 2.0**top, S.tile_x(F.col("lng"), top).alias("ox"), S.tile_y(F.col("lat"), top).alias("oy"), F.isnan("lat").alias("_n"), F.isnan("lng").alias("_o"))
    # Each row is its fix, a tile, and its line, if it has one.
    s = s.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).filter(F.when(F.col("own"), F.col("ox").isNotNull() & F.col("oy").isNotNull() & ~F.col("_n") & ~F.col("_o")).otherwise(_whole()))
    s = s.withColumn("x0", F.when(F.col("own"), F.col("ox")).otherwise(F.floor(F.least("px", "qx")))).withColumn("x1", F.when(F.col("own"), F.col("ox")).otherwise(F.floor(F.greatest("px", "qx"))))
    height = lambda x: F.when(F.col("qx") == F.col("px"), None).otherwise(F.col("py") + (F.col("qy") - F.col("py")) * (x - F.col("px")) / (F.col("qx") - F.col("px")))
    s = explode_range(s, "x0", "x1", "x")
    ya, yb = F.coalesce(height(F.greatest(F.least("px", "qx"), F.col("x"))), F.col("py")), F.coalesce(height(F.least(F.greatest("px", "qx"), F.col("x") + 1)), F.col("qy"))
    s = s.withColumn("y0", F.when(F.col("own"), F.col("oy")).otherwise(F.floor(F.least(ya, yb)))).withColumn("y1", F.when(F.col("own"), F.col("oy")).otherwise(F.floor(F.greatest(ya, yb))))
    return parents(explode_range(s, "y0", "y1", "y").select("track_id", "x", "y"), top, zooms)


def with_halo(tiles: DataFrame) -> DataFrame:
    """Tiles of each track (track_id, z, x, y) and the eight around each, within the map."""
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
    t = tiles.withColumn("o", around).select("track_id", "z", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    n = F.pow(F.lit(2.0), F.col("z"))
    return t.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < n) & (F.col("y") < n)).distinct()


def tile_plan(points: DataFrame, zooms: list[int], halo: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """Tiles to draw with their number of tracks: those that tracks touch, with a halo the eight around each too; existing ones (z, x, y) are skipped."""
    t = with_halo(line_tiles(points, zooms)) if halo else line_tiles(points, zooms)
    plan = t.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("tracks"))
    return plan if existing is None else plan.join(existing.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


#: Columns of strokes that are worked on at once (their arrays fit into a core's cache), and sums that a task keeps before it gives them out.
COLUMNS, KEPT = 1 << 12, 1 << 20


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(values), len(found)).astype(np.int64)


def _lit(zoom: int, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (gx times the map's side plus gy) of stretches of strokes at one zoom, all steep or none, and what these add to them.

    A stretch is columns `from` to `to` along the stroke's longer side; across
    it, pixels are looked at as far as `across` from the line. The arithmetic
    is that of the query's SQL, step by step, in place.
    """
    radius, intensity, most = max(of_zoom(WIDTHS, zoom) / 2, 0.75), of_zoom(INTENSITIES, zoom), SIZE * 2**zoom
    n = s["to"] - s["from"] + 1
    at = np.repeat(np.arange(len(n)), n)
    gu = s["from"][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    pu, pv, du, dv, ll, across = (s[c][at] for c in ("pu", "pv", "du", "dv", "ll", "across"))
    dot = ll <= 0.0001
    u = gu + 0.5 - pu
    mid = pv + dv * np.where(dot, 0.0, np.clip(u / np.where(du == 0, 1.0, du), 0.0, 1.0))
    gv, wide = np.ceil(mid - across - 0.5).astype(np.int64), np.arange(int(2 * across.max()) + 2)
    v = (gv + 0.5)[:, None] + wide
    v -= pv[:, None]
    share = v * dv[:, None]
    share += (u * du)[:, None]
    share /= np.where(dot, 1.0, ll)[:, None]
    np.minimum(share, 1.0, out=share)
    np.maximum(share, 0.0, out=share)
    share[dot] = 0.0
    away = share * du[:, None]
    np.subtract(u[:, None], away, out=away)
    away *= away
    share *= dv[:, None]
    v -= share
    v *= v
    away += v
    edge = np.sqrt(away, out=away)
    edge -= radius
    np.minimum(edge, 1.0, out=edge)
    np.maximum(edge, 0.0, out=edge)
    np.multiply(edge, -2.0, out=v)
    v += 3.0
    edge *= edge
    edge *= v
    np.subtract(1.0, edge, out=edge)
    edge *= intensity
    edge += 0.5
    value = np.floor(edge, out=edge).ravel()
    u0, v0 = int(gu.min()), int(gv.min())
    high = int(gv.max()) - v0 + len(wide)
    grid = ((gu - u0) * high + (gv - v0))[:, None] + wide
    size = (int(gu.max()) - u0 + 1) * high
    if size <= 8 * len(value):
        sums = np.bincount(grid.ravel(), value, size)
        cells = np.flatnonzero(sums)
        sums = sums[cells]
    else:  # too far apart for a grid around them all
        lit = np.flatnonzero(value)
        cells, sums = _added([grid.ravel()[lit]], [value[lit]])
    gu, gv = cells // high + u0, cells % high + v0
    keep = (gu >= 0) & (gu < most) & (gv >= 0) & (gv < most)
    gu, gv = gu[keep], gv[keep]
    return (gv * most + gu if s["steep"][0] else gu * most + gv), sums[keep].astype(np.int64)


def _drawn(batches):
    """Arrow batches of stretches of strokes into sums by zoom and pixel, added up within the task as far as KEPT allows."""
    kept = {}

    def out(zoom):
        keys, values = (np.concatenate(x) for x in zip(*kept.pop(zoom)))
        most = SIZE * 2**zoom
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), zoom, np.int32)), pa.array(keys // most), pa.array(keys % most), pa.array(values)], names=["z", "gx", "gy", "value"])

    for b in batches:
        rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        for zoom, steep in itertools.product(np.unique(rows["z"]).tolist(), (False, True)):
            some = (rows["z"] == zoom) & (rows["steep"] == steep)
            s = {c: v[some] for c, v in rows.items()}
            part = np.cumsum(s["to"] - s["from"] + 1) // COLUMNS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)] if some.any() else []
            for lo, hi in itertools.pairwise(cuts):
                have = kept.setdefault(zoom, [])
                have.append(_lit(zoom, {c: v[lo:hi] for c, v in s.items()}))
                if sum(len(k) for k, _ in have) > KEPT:
                    have[:] = [_added(*map(list, zip(*have)))]
                    if len(have[0][0]) > KEPT // 2:
                        yield out(zoom)
    for zoom in list(kept):
        kept[zoom] = [_added(*map(list, zip(*kept[zoom])))]
        yield out(zoom)


def strokes(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Every line between two points at each zoom, turned so that its longer side is u, in stretches of at most STRETCH columns."""
    drawn = F.explode(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(max(of_zoom(WIDTHS, z) / 2, 0.75) + 1.0).alias("outer"), F.lit(float(SIZE * 2**z)).alias("scale")) for z in dict.fromkeys(zooms))))
    s = segments(points, 1.0).withColumn("_z", drawn).select("_z.z", "_z.outer", *((F.col(c) * F.col("_z.scale")).alias(c) for c in ("px", "py", "qx", "qy")))
    steep = F.abs(F.col("qy") - F.col("py")) > F.abs(F.col("qx") - F.col("px"))
    turned = lambda a, b, name: F.when(steep, F.col(a)).otherwise(F.col(b)).alias(name)
    s = s.select("z", "outer", steep.alias("steep"), turned("py", "px", "pu"), turned("px", "py", "pv"), turned("qy", "qx", "qu"), turned("qx", "qy", "qv"))
    du, dv = F.col("qu") - F.col("pu"), F.col("qv") - F.col("pv")
    s = s.withColumns({"du": du, "dv": dv, "ll": du * du + dv * dv, "u0": F.floor(F.least("pu", "qu") - F.col("outer")), "u1": F.ceil(F.greatest("pu", "qu") + F.col("outer"))})
    # A line of slope dv / du is this far away, along v, where it is `outer` away across; a bit more for rounding.
    across = F.when(F.col("du") == 0, F.col("outer")).otherwise(F.col("outer") * F.sqrt(1 + F.col("dv") * F.col("dv") / (F.col("du") * F.col("du")))) + 0.001
    s = s.withColumns({"across": across, "from": F.explode(F.expr(f"sequence(u0, u1, {STRETCH})"))})
    return s.select("z", "steep", "pu", "pv", "du", "dv", "ll", "across", "from", F.least(F.col("from") + (STRETCH - 1), F.col("u1")).alias("to"))


def pixel_intensity(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Intensity of each pixel of each tile: every line between two points is a stroke with round, smoothed ends.

    A stroke adds the zoom's intensity, times a smooth step over the last
    pixel of its width, to each pixel; sums stop at SATURATION. Pixels are
    found along the stroke's longer side, and across it as far as it is wide.
    All zooms come from one pass over the tracks. A task adds up its strokes
    as arrays, so a pixel that every track crosses is one row a task; a tile
    has at most SIZE squared rows in the end.
    """
    added = strokes(points, zooms).mapInArrow(_drawn, "z int, gx long, gy long, value long").groupBy("z", "gx", "gy").agg(F.least(F.sum("value"), F.lit(SATURATION)).alias("intensity"))
    return added.select("z", F.floor(F.col("gx") / SIZE).alias("x"), F.floor(F.col("gy") / SIZE).alias("y"), F.pmod("gx", F.lit(SIZE)).cast("int").alias("col"), F.pmod("gy", F.lit(SIZE)).cast("int").alias("row"), "intensity")


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image as a PNG file."""
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def blur(grid: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian, edges extended."""
    p = np.pad(grid.astype(float), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16


def colours(grid: np.ndarray) -> np.ndarray:
    """Exposure (saturating with the intensity) and gradient as RGBA."""
    share = 1 - np.exp(-grid / 90.0)
    stops = np.array(GRADIENT, float)
    return np.stack([np.interp(share, stops[:, 0], stops[:, c]) for c in range(1, 5)], -1).round().astype(np.uint8)


def rendered(pixels: DataFrame) -> DataFrame:
    """A PNG for each tile (z, x, y); a tile's rows are its lit pixels, SIZE squared at most."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((SIZE, SIZE))
        grid[pdf["row"], pdf["col"]] = pdf["intensity"]
        z = int(pdf["z"].iloc[0])
        if z <= BLUR_TO_ZOOM:
            grid = blur(grid)
        return pd.DataFrame({"z": [z], "x": [int(pdf["x"].iloc[0])], "y": [int(pdf["y"].iloc[0])], "lit": [len(pdf)], "png": [png(colours(grid))]})

    return pixels.groupBy("z", "x", "y").applyInPandas(draw, "z int, x long, y long, lit long, png binary")


def stale_tiles(plan: DataFrame, changed: DataFrame, zooms: list[int]) -> DataFrame:
    """Tiles of a plan that a changed box (min_lat, max_lat, min_lng, max_lng) touches.

    A box is named by the two by two tiles, at most, of a zoom so coarse that
    they hold it; tiles of the plan meet it there by an equi-join and are then
    tested. So a country at a fine zoom is four rows, not its millions of tiles.
    """
    z = changed.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    span = z.select(
        "z", S.tile_x(F.col("min_lng"), F.col("z")).alias("x0"), S.tile_x(F.col("max_lng"), F.col("z")).alias("x1"), S.tile_y(F.col("max_lat"), F.col("z")).alias("y0"), S.tile_y(F.col("min_lat"), F.col("z")).alias("y1")
    )
    span = span.withColumn("up", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1)))).cast("int"))
    tall = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("up")))
    cells = span.withColumn("cx", F.explode(F.array_distinct(F.array(tall("x0"), tall("x1"))))).withColumn("cy", F.explode(F.array_distinct(F.array(tall("y0"), tall("y1")))))
    # At most a row for each two zooms, so it is broadcast.
    levels = span.select("z", "up").distinct()
    up = plan.join(F.broadcast(levels), "z").withColumn("cx", tall("x")).withColumn("cy", tall("y"))
    within = up.join(cells, ["z", "up", "cx", "cy"]).filter("x between x0 and x1 and y between y0 and y1")
    return within.select(*plan.columns).distinct()


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Write each tile's PNG to path/z/x/y.png; the tasks write, to any store that pyarrow knows, and repeats overwrite."""

    def put(rows):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path)
        for r in rows:
            folder = f"{root}/{r['z']}/{r['x']}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{r['y']}.png", compression=None) as f:
                f.write(bytes(r["png"]))

    tiles.select("z", "x", "y", "png").foreachPartition(put)
