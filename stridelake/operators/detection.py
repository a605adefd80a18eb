"""Route grouping, section detection and section upkeep.

Grouping and detection are specified anew here (from the shape of their
inputs and outputs); the other operators edit sections as tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalar import haversine
from stridelake.operators.graph import connected_components, ensure_checkpoint_dir
from stridelake.operators.spatial import METRES_PER_DEGREE, line_overlaps, near_box, radius_join


@dataclass(frozen=True)
class DetectionConfig:
    """Parameters of grouping and detection."""

    endpoint_m: float = 500.0
    length_ratio: float = 0.8
    cell_deg: float = 0.002
    least_tracks: int = 3
    least_cells: int = 2
    proximity_m: float = 50.0
    merge_overlap: float = 0.3


def step_lengths(points: DataFrame) -> DataFrame:
    """points (track_id, seq, lat, lng) with the metres from the point before."""
    w = Window.partitionBy("track_id").orderBy("seq")
    return points.withColumn("step", F.coalesce(haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0)))


def signatures(points: DataFrame) -> DataFrame:
    """End points and length of each track."""
    first, last = F.min(F.struct("seq", "lat", "lng")), F.max(F.struct("seq", "lat", "lng"))
    return step_lengths(points).groupBy("track_id").agg(
        first["lat"].alias("lat"), first["lng"].alias("lng"), last["lat"].alias("end_lat"), last["lng"].alias("end_lng"), F.sum("step").alias("metres_long"), F.count(F.lit(1)).alias("points")
    )


def route_edges(sigs: DataFrame, cfg: DetectionConfig, where: Column | None = None) -> DataFrame:
    """Pairs of tracks that start and end close to each other and are of similar length; `where` may compare _root with other_root."""
    names = {"track_id": "other_id", "lat": "rlat", "lng": "rlng", "end_lat": "oend_lat", "end_lng": "oend_lng", "metres_long": "other_long", "_root": "other_root"}
    mine = [c for c in names if c in sigs.columns]
    other = sigs.select(*(F.col(c).alias(names[c]) for c in mine))
    pairs = radius_join(sigs.select(*mine), other, cfg.endpoint_m).filter("track_id < other_id")
    if where is not None:
        pairs = pairs.filter(where)
    ratio = F.least("metres_long", "other_long") / F.greatest("metres_long", "other_long")
    ends = haversine(F.col("end_lat"), F.col("end_lng"), F.col("oend_lat"), F.col("oend_lng"))
    return pairs.filter((ratio >= cfg.length_ratio) & (ends <= cfg.endpoint_m)).select(F.col("track_id").alias("a"), F.col("other_id").alias("b"))


def route_groups(points: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """track_id and route (the smallest track of its group), lone tracks included."""
    return grouped(signatures(points), cfg)


def grouped(sigs: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """The same from signatures."""
    return with_routes(sigs, cfg)


def _blocks(sigs: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """sigs with _block: tracks of one block start and end within less than the radius of each other, and are of similar length."""
    side = cfg.endpoint_m / 1.5 / METRES_PER_DEGREE  # the diagonal is 0.95 of the radius

    def cell(lat: Column, lng: Column) -> Column:
        y = F.floor(lat / side)
        least = F.least(F.abs(y * side), F.abs((y + 1) * side))  # where the cell is widest
        return F.struct(y.alias("y"), F.floor(lng / (side / F.cos(F.radians(F.when((y == 0) | (y == -1), 0.0).otherwise(least))))).alias("x"))

    band = F.floor(F.ln("metres_long") / -math.log(cfg.length_ratio) * 1.01).cast("double") if 0 < cfg.length_ratio < 1 else F.col("metres_long")
    return sigs.withColumn("_block", F.struct(cell(F.col("lat"), F.col("lng")).alias("a"), cell(F.col("end_lat"), F.col("end_lng")).alias("b"), band.alias("l")))


def with_routes(sigs: DataFrame, cfg: DetectionConfig, known: DataFrame | None = None) -> DataFrame:
    """track_id and route of all tracks of sigs, also by edges (a, b) that are known.

    A block's tracks belong together, so its smallest track stands for them.
    What the blocks' first tracks link makes components; then only tracks of
    near blocks in different components are compared. So pairs grow with the
    blocks, not with the square of the tracks.
    """
    ensure_checkpoint_dir(sigs.sparkSession)
    whole = sigs.filter("lat is not null and lng is not null and end_lat is not null and end_lng is not null and metres_long > 0")
    rows = _blocks(whole, cfg).select("track_id", "lat", "lng", "end_lat", "end_lng", "metres_long", "_block").checkpoint()
    heads = rows.groupBy("_block").agg(F.min_by(F.struct("track_id", "lat", "lng", "end_lat", "end_lng", "metres_long"), "track_id").alias("h")).select("_block", "h.*").checkpoint()
    stars = rows.select("_block", F.col("track_id").alias("b")).join(heads.select("_block", F.col("track_id").alias("a")).hint("merge"), "_block").select("a", "b")
    first = stars.unionByName(route_edges(heads.drop("_block"), cfg))
    if known is not None:
        first = first.unionByName(known.select("a", "b"))
    first = first.filter("a <> b").checkpoint()
    roots = connected_components(first)
    named = heads.join(roots.hint("merge"), heads["track_id"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "track_id")).drop("node", "root").checkpoint()
    # A track is within 0.95 of the radius of its head, at either end; 0.9999 leaves room for rounding.
    wide = replace(cfg, endpoint_m=cfg.endpoint_m * 3, length_ratio=cfg.length_ratio**3 * 0.9999)
    of = lambda a: named.select(F.col("track_id").alias(a), F.col("_block").alias(f"{a}_block"), F.col("_root").alias(f"{a}_root"))
    near = route_edges(named, wide, F.col("_root") != F.col("other_root")).join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    one = near.select("a_block", "b_block").join(rows.withColumnRenamed("_block", "a_block").hint("merge"), "a_block").drop("a_block")
    two = rows.select(F.col("_block").alias("b_block"), *(F.col(c).alias(f"o_{c}") for c in rows.columns if c != "_block"))
    pairs = one.join(two.hint("merge"), "b_block")
    ratio = F.least("metres_long", "o_metres_long") / F.greatest("metres_long", "o_metres_long")
    starts = haversine(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))
    ends = haversine(F.col("end_lat"), F.col("end_lng"), F.col("o_end_lat"), F.col("o_end_lng"))
    more = pairs.filter((ratio >= cfg.length_ratio) & (starts <= cfg.endpoint_m) & (ends <= cfg.endpoint_m)).select(F.col("track_id").alias("a"), F.col("o_track_id").alias("b"))
    roots = connected_components(first.unionByName(more))
    return sigs.join(roots.hint("merge"), sigs["track_id"] == roots["node"], "left").select("track_id", F.coalesce("root", "track_id").alias("route"))


def busy_cells(points: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Grid cells that enough tracks pass through, with their number."""
    cells = points.select("track_id", F.floor(F.col("lat") / cfg.cell_deg).alias("y"), F.floor(F.col("lng") / cfg.cell_deg).alias("x")).distinct()
    return cells.groupBy("y", "x").agg(F.count(F.lit(1)).alias("tracks")).filter(F.col("tracks") >= cfg.least_tracks)


def _code(y, x):
    return (y + 10**8) * 10**9 + x + 10**8


def detected_sections(points: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Corridors: connected runs (eight neighbours) of busy cells, with size and traffic."""
    cells = busy_cells(points, cfg)
    around = F.explode(F.expr("array(struct(0 as i, 1 as j), struct(1 as i, -1 as j), struct(1 as i, 0 as j), struct(1 as i, 1 as j))"))
    steps = cells.select(_code(F.col("y"), F.col("x")).alias("a"), "y", "x", around.alias("o")).select("a", (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x"))
    roots = connected_components(steps.join(cells, ["y", "x"]).select("a", _code(F.col("y"), F.col("x")).alias("b")))
    named = cells.withColumn("node", _code(F.col("y"), F.col("x"))).join(roots, "node", "left").withColumn("section", F.coalesce("root", "node"))
    return named.groupBy("section").agg(F.count(F.lit(1)).alias("cells"), F.max("tracks").alias("peak"), F.sum("tracks").alias("passes")).filter(F.col("cells") >= cfg.least_cells)


def consensus(points: DataFrame, cell_deg: float) -> DataFrame:
    """Mean position, and number of tracks, of the points in each cell of a corridor."""
    rows = points.withColumn("y", F.floor(F.col("lat") / cell_deg)).withColumn("x", F.floor(F.col("lng") / cell_deg))
    return rows.groupBy("y", "x").agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lng"), 9).alias("lng"), F.countDistinct("track_id").alias("tracks"))


def candidates_by_box(boxes: DataFrame, min_lat: float, max_lat: float, min_lng: float, max_lng: float, proximity_m: float) -> DataFrame:
    """Rows whose box comes within twice the proximity of another box."""
    return boxes.filter(near_box(min_lat, max_lat, min_lng, max_lng, 2 * proximity_m, (F.col("min_lat"), F.col("max_lat")), (F.col("min_lng"), F.col("max_lng"))))


def pruned(sections: DataFrame, points: DataFrame, counts: DataFrame, threshold_m: float, least: float) -> DataFrame:
    """Automatic sections without those that a busier one of the same sport covers (ties: the smaller id stays).

    Covered: at least the share `least` of its points (section_id, point, lat,
    lng) lies within the threshold of the other's. Of each kind of polyline
    the busiest section stands for the others.
    """
    s = sections.filter("section_type = 'auto'").join(counts.select("section_id", "laps"), "section_id", "left").select("section_id", "sport_type", F.coalesce("laps", F.lit(0)).alias("laps"))
    over, members = line_overlaps(points.join(s.select("section_id", "sport_type").hint("merge"), "section_id"), threshold_m, ["sport_type"])
    rated = s.select("section_id", "sport_type", "laps", F.struct("laps", (-F.col("section_id")).alias("n")).alias("rate")).join(members.hint("merge"), "section_id", "left")
    best = rated.groupBy(F.col("kind").alias("other_kind")).agg(F.max("rate").alias("best"))
    above = over.filter(F.col("fraction") >= least).join(best.hint("merge"), "other_kind").groupBy("kind").agg(F.max("best").alias("above"))
    return rated.join(above.hint("merge"), "kind", "left").filter(F.col("above").isNull() | (F.col("above") <= F.col("rate"))).select("section_id", "sport_type", "laps")


def merged_traversals(traversals: DataFrame, moves: DataFrame) -> DataFrame:
    """Traversals with each secondary section's rows moved to its primary; a row that the primary has already goes.

    moves: secondary, primary; a section that moves to itself stays as it is.
    """
    m = moves.filter("secondary <> primary")
    t = traversals.join(m, traversals["section_id"] == m["secondary"], "left").withColumn("moved", F.col("primary").isNotNull().cast("int")).withColumn("section_id", F.coalesce("primary", "section_id")).drop("primary", "secondary")
    w = Window.partitionBy("section_id", "activity_id", "start_index").orderBy("moved", "distance_meters", "lap_time")
    return t.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "moved")


def numbered_names(sections: DataFrame, word: str = "Section") -> DataFrame:
    """Names "{sport} {word} {n}" for sections without one, taking the smallest numbers that the sport has free."""
    n = F.regexp_extract("name", rf"^\S+ {word} (\d+)$", 1)
    taken = sections.filter(n != "").select("sport_type", n.cast("long").alias("n")).distinct()
    blank = sections.filter("name is null").withColumn("k", F.row_number().over(Window.partitionBy("sport_type").orderBy("section_id")))
    # The k-th free number is at most k plus the number of taken ones.
    size = taken.groupBy("sport_type").agg(F.count(F.lit(1)).alias("t"))
    most = blank.groupBy("sport_type").agg(F.count(F.lit(1)).alias("b")).join(size, "sport_type", "left")
    free = most.select("sport_type", F.explode(F.sequence(F.lit(1), (F.col("b") + F.coalesce("t", F.lit(0))))).alias("n")).join(taken, ["sport_type", "n"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("sport_type").orderBy("n")))
    return blank.join(free, ["sport_type", "k"]).select("section_id", F.concat_ws(" ", "sport_type", F.lit(word), F.col("n").cast("string")).alias("name"))


def edited(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Sections with edits applied: per section the last edit by `at` of each field (name, disabled, superseded_by) that it sets."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}")
    e = edits.groupBy("section_id").agg(*(last(c) for c in ("name", "disabled", "superseded_by")))
    return sections.join(e, "section_id", "left").select("section_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("name", "disabled", "superseded_by")))


def trimmed(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Points and length of each track between two positions (bounds: track_id, first, last), both included."""
    rows = points.join(bounds, "track_id").filter(F.col("seq").between(F.col("first"), F.col("last")))
    return step_lengths(rows.select("track_id", "seq", "lat", "lng")).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("step"), 3).alias("metres"))
