"""Heatmap queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.operators import heatmap as op
from stridelake.plans.registry import query

ZOOMS = list(range(1, op.FINEST + 1))
# Tiles at the finest zoom, of points and of the lines between them; coarser ones hold them.
FINE = """, pw as (select track_id, row_number() over (partition by track_id order by t, point_id) seq, (lng + 180) / 360 * 131072 px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 131072 py from points),
    pt as (select distinct track_id, floor(px)::bigint x, floor(py)::bigint y from pw)"""
SWEPT = FINE + """, sg as (select *, lead(px) over w qx, lead(py) over w qy from pw window w as (partition by track_id order by seq)),
    cl as (select *, unnest(range(floor(least(px, qx))::bigint, floor(greatest(px, qx))::bigint + 1)) x from sg where qx is not null),
    ht as (select track_id, x, case when qx = px then py else py + (qy - py) * (greatest(least(px, qx), x) - px) / (qx - px) end ya, case when qx = px then qy else py + (qy - py) * (least(greatest(px, qx), x + 1) - px) / (qx - px) end yb from cl),
    lt as (select distinct track_id, x, y from (select track_id, x, unnest(range(floor(least(ya, yb))::bigint, floor(greatest(ya, yb))::bigint + 1)) y from ht) union select * from pt)"""
PARENTS = "select distinct track_id, z, x >> (17 - z) x, y >> (17 - z) y from (select *, unnest(range(1, 18))::int z from {})"


#: Fixes for each task that draws tracks: a fix becomes hundreds of rows.
TASK_FIXES = 1 << 15


def tracks(t):
    """Points in order, dealt by track over as many tasks as their number asks for (one count reaches the driver)."""
    p = t.points
    n = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // TASK_FIXES))
    return p.repartition(n, "track_id").withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id")))


@query("h1_point_tiles", FINE + " " + PARENTS.format("pt"))
def tiles(t):
    return op.point_tiles(t.points, ZOOMS)


@query("h2_h3_tile_plan", SWEPT + ", zt as (" + PARENTS.format("lt") + "), h as (select distinct track_id, z, x + i x, y + j y from zt, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)) select z, x, y, count(*) tracks from h where x >= 0 and y >= 0 and x < pow(2, z) and y < pow(2, z) group by 1, 2, 3")
def plan(t):
    return op.tile_plan(tracks(t), ZOOMS)


DRAWN = [3, 8, 10]
STROKES = " union all ".join(f"select {z} z, {max(op.of_zoom(op.WIDTHS, z) / 2, 0.75)}::double radius, {op.of_zoom(op.INTENSITIES, z)}::double intensity, {op.SIZE * 2**z}::double scale" for z in DRAWN)


@query("h4_pixel_intensity", f""", zs as ({STROKES}), w as (select track_id, z, radius, intensity, row_number() over (partition by track_id, z order by t, point_id) seq, (lng + 180) / 360 * scale px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * scale py from points, zs),
    s as (select *, lead(px) over (partition by track_id, z order by seq) qx, lead(py) over (partition by track_id, z order by seq) qy from w),
    gx as (select *, unnest(range(floor(least(px, qx) - radius - 1)::bigint, ceil(greatest(px, qx) + radius + 1)::bigint + 1)) gx from s where qx is not null),
    g as (select *, unnest(range(floor(least(py, qy) - radius - 1)::bigint, ceil(greatest(py, qy) + radius + 1)::bigint + 1)) gy, (qx - px) * (qx - px) + (qy - py) * (qy - py) ll from gx),
    a as (select *, case when ll <= 0.0001 then 0 else greatest(least(((gx + 0.5 - px) * (qx - px) + (gy + 0.5 - py) * (qy - py)) / ll, 1), 0) end share from g),
    e as (select z, gx, gy, intensity, greatest(least(sqrt(pow(gx + 0.5 - px - share * (qx - px), 2) + pow(gy + 0.5 - py - share * (qy - py), 2)) - radius, 1), 0) edge from a),
    v as (select z, gx, gy, floor(intensity * (1 - edge * edge * (3 - 2 * edge)) + 0.5)::bigint v from e)
    select z, gx // 512 x, gy // 512 y, (gx % 512)::int col, (gy % 512)::int as row, least(sum(v), 65535)::bigint intensity from v where v > 0 group by z, gx, gy""")
def pixels(t):
    """Strokes at three zooms, each with its width and intensity."""
    return op.pixel_intensity(tracks(t), DRAWN)


@query("h5_h6_rendered_tiles")
def rendered(t):
    return op.rendered(op.pixel_intensity(tracks(t), [9])).select("z", "x", "y", "lit", F.octet_length("png").alias("bytes"), F.sha2("png", 256).alias("digest"))


@query("h7_stale_tiles", SWEPT + ", zt as (" + PARENTS.format("lt") + """), p as (select z, x, y, count(*) tracks from zt group by 1, 2, 3)
    select * from p where x between floor((7.0 + 180) / 360 * pow(2, z)) and floor((7.005 + 180) / 360 * pow(2, z)) and y between floor((1 - ln(tan(radians(46.05)) + 1 / cos(radians(46.05))) / pi()) / 2 * pow(2, z)) and floor((1 - ln(tan(radians(46.0)) + 1 / cos(radians(46.0))) / pi()) / 2 * pow(2, z))""")
def stale(t):
    box = t.spark.createDataFrame([(46.0, 46.05, 7.0, 7.005)], "min_lat double, max_lat double, min_lng double, max_lng double")
    return op.stale_tiles(op.tile_plan(tracks(t), ZOOMS, halo=False), box, ZOOMS)
