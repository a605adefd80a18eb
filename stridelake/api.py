"""The engine's call surface by subject: each method returns a DataFrame over the engine's tables.

`tables` is any object with the attributes of sources.adapters.Tables (metrics,
activities, sections, traversals, wellness, exercise_sets, points).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators import detection as det
from stridelake.operators import editing as edi
from stridelake.operators import fitness as fit
from stridelake.operators import flows as flo
from stridelake.operators import heatmap as heat
from stridelake.operators import insights as ins
from stridelake.operators import keeping as kee
from stridelake.operators import patterns as pat
from stridelake.operators import routes as rou
from stridelake.operators import sections as sec
from stridelake.operators import spatial as spa
from stridelake.operators import strength as stg
from stridelake.operators import upkeep as upk
from stridelake.sources import tables as io
from stridelake.sources.adapters import visible
from stridelake.streaming.indexing import TrackIndex


class Fitness:
    def __init__(self, tables):
        self.t = tables

    def period_stats(self, start: int, end: int) -> DataFrame:
        return fit.period_stats(self.t.metrics, start, end)

    def zone_distribution(self, sport: str, kind: str) -> DataFrame:
        return fit.zone_distribution(self.t.metrics, sport, kind)

    def heatmap(self) -> DataFrame:
        return fit.day_heatmap(self.t.metrics)

    def ftp_trend(self) -> DataFrame:
        return fit.threshold_change(self.t.metrics, "ftp", fit.FTP_SPORTS)

    def sparklines(self, days: int = 28) -> DataFrame:
        return fit.heart_series(self.t.wellness, days)

    def hrv_trend(self, days: int = 28) -> DataFrame:
        return fit.hrv_trend(self.t.wellness, days)

    def sports(self) -> DataFrame:
        return self.t.metrics.select("sport_type").distinct().orderBy("sport_type")

    def period_comparison(self, monday: int) -> DataFrame:
        return ins.period_comparison(self.t.metrics, monday)


class Sections:
    def __init__(self, tables):
        self.t = tables

    @cached_property
    def laps(self) -> DataFrame:
        """Shared by the methods below; cache() it to ask for several."""
        return sec.laps(self.t.traversals, self.t.sections, self.t.metrics)

    def summaries(self, only_visible: bool = True) -> DataFrame:
        s = self.t.sections.filter(visible()) if only_visible else self.t.sections
        return sec.summaries(s, self.t.traversals, self.t.metrics)

    def performances(self, section_id: int) -> DataFrame:
        return sec.activity_records(self.laps.filter(F.col("section_id") == section_id)).orderBy("date")

    def records(self) -> DataFrame:
        return sec.section_records(self.laps)

    def excluded(self) -> DataFrame:
        return sec.excluded_records(self.t.traversals, self.t.metrics)

    def calendar(self, section_id: int) -> DataFrame:
        return sec.calendar(self.laps.filter(F.col("section_id") == section_id)).orderBy(F.desc("year"), F.desc("month"), "side")

    def chart(self, section_id: int) -> DataFrame:
        return sec.chart(self.laps.filter(F.col("section_id") == section_id))

    def ranked(self, now: int, per_sport: int = 10) -> DataFrame:
        return sec.top_ranked(sec.ranked(self.laps, now), per_sport)

    def indicators(self) -> DataFrame:
        return sec.indicators(sec.timed(self.t.traversals, self.t.sections, self.t.activities))

    def history(self) -> DataFrame:
        return sec.lap_history(self.laps, self.t.activities)

    def nearby(self, radius_m: float = 500.0) -> DataFrame:
        return spa.nearby(self.t.sections, radius_m)

    def merge_pairs(self) -> DataFrame:
        return spa.merge_pairs(self.t.sections)

    def pruned(self, threshold_m: float = 50.0, least: float = 0.5) -> DataFrame:
        return det.pruned(self.t.sections, self.t.section_points, sec.visit_counts(self.t.traversals), threshold_m, least)

    def merge_candidates(self, centre_m: float = 300.0) -> DataFrame:
        return spa.merge_candidates(self.t.sections, self.t.section_points, centre_m)


    def edited(self, sections: DataFrame, events: DataFrame) -> DataFrame:
        """A table of sections after a log of edits, see editing.folded."""
        return edi.folded(sections, events)

    def extension(self, sections: DataFrame, tracks: DataFrame) -> DataFrame:
        return edi.extension(sections, self.t.section_points, tracks)

    def rematched(self, sections: DataFrame, lines: DataFrame, tracks: DataFrame, track_sports: DataFrame) -> DataFrame:
        return edi.rematched(sections, lines, tracks, track_sports)

    def saved(self, sections: DataFrame, detected: DataFrame) -> DataFrame:
        """A table of sections after a detection, see keeping.saved."""
        return kee.saved(sections, detected)


class Detection:
    """Detection over tracks (track_id, seq, lat, lng), whole or with what is new."""

    def __init__(self, tables, config: det.DetectionConfig = det.DetectionConfig()):
        self.t, self.config = tables, config

    def groups(self, points: DataFrame) -> DataFrame:
        return det.route_groups(points, self.config)

    def regrouped(self, points: DataFrame, groups: DataFrame) -> DataFrame:
        return upk.grouped_with_new(points, groups, self.config)

    def corridors(self, points: DataFrame) -> DataFrame:
        return det.detected_sections(points, self.config)

    def potential(self, points: DataFrame) -> DataFrame:
        return det.busy_cells(points, self.config)

    def turns(self, points: DataFrame, stored: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """Turns of all tracks; where those of known tracks are stored, see flows.detected_with_new."""
        if stored is None or known is None:
            return flo.turns(points, self.config.cell_deg)
        return flo.detected_with_new(points, stored, known, self.config)

    def flow_sections(self, turns: DataFrame) -> DataFrame:
        return flo.flow_sections(turns, self.config)

    def index(self, path: str) -> TrackIndex:
        """An index that new tracks are matched with, stored at path."""
        return TrackIndex(self.t.spark, path, self.t.sections, self.t.section_points, self.config)


class Routes:
    def __init__(self, tables):
        self.t = tables

    @cached_property
    def members(self) -> DataFrame:
        return rou.members(self.t.metrics)

    def groups(self) -> DataFrame:
        return rou.summaries(self.t.metrics)

    def performances(self, route_id: int) -> DataFrame:
        return rou.performances(self.members.filter(F.col("route_id") == route_id))

    def statistics(self) -> DataFrame:
        return rou.statistics(self.members)

    def highlights(self) -> DataFrame:
        return rou.highlights(self.members)


class Activities:
    def __init__(self, tables):
        self.t = tables

    def in_viewport(self, min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> DataFrame:
        return self.t.activities.filter(spa.in_viewport(min_lat, max_lat, min_lng, max_lng))

    def by_sport(self, sport: str) -> DataFrame:
        return self.t.activities.filter(F.col("sport_type") == sport)

    def metrics_for(self, ids: DataFrame) -> DataFrame:
        return self.t.metrics.join(ids.select("activity_id"), "activity_id", "left_semi")

    def without(self, gone: DataFrame) -> DataFrame:
        return io.without(self.t.activities, gone, "activity_id")

    def clusters(self, cell_deg: float = 0.02) -> DataFrame:
        return spa.box_clusters(self.t.activities, cell_deg)

    def patterns(self, by: list[str]) -> DataFrame:
        f = pat.normalised(self.t.metrics, by)
        return pat.patterns(f, pat.clusters(f, by), by)


class Strength:
    def __init__(self, tables):
        self.t = tables

    def sets(self, start: int, end: int) -> DataFrame:
        return stg.active_sets(self.t.exercise_sets, self.t.metrics, start, end)

    def summary(self, start: int, end: int) -> DataFrame:
        return stg.muscle_summary(self.sets(start, end))

    def series(self, ranges: DataFrame, start: int, end: int) -> DataFrame:
        return stg.ranged_summary(self.sets(start, end), ranges)

    def exercises(self, muscle: str, start: int, end: int) -> DataFrame:
        return stg.exercises_of_muscle(self.sets(start, end), muscle)

    def balance(self, start: int, end: int) -> DataFrame:
        return stg.balance(self.summary(start, end))


class Maps:
    def __init__(self, tables):
        self.t = tables

    @cached_property
    def tracks(self) -> DataFrame:
        return self.t.points.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "point_id")))

    def bounds(self, start: int, end: int, sports: list[str]) -> DataFrame:
        return fit.bounds_union(self.t.activities, self.t.metrics, start, end, sports)

    def tile_plan(self, zooms: list[int]) -> DataFrame:
        return heat.tile_plan(self.tracks, zooms)

    def tiles(self, zoom: int) -> DataFrame:
        return heat.rendered(heat.pixel_intensity(self.tracks, [zoom]))

    def route_groups(self, cfg: det.DetectionConfig = det.DetectionConfig()) -> DataFrame:
        return det.route_groups(self.tracks, cfg)

    def detected_sections(self, cfg: det.DetectionConfig = det.DetectionConfig()) -> DataFrame:
        return det.detected_sections(self.tracks, cfg)


class Engine:
    """All subjects over one set of tables."""

    def __init__(self, tables):
        self.fitness, self.sections, self.routes = Fitness(tables), Sections(tables), Routes(tables)
        self.activities, self.strength, self.maps = Activities(tables), Strength(tables), Maps(tables)
        self.detection = Detection(tables)
