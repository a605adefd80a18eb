"""Indexing of new tracks as they come in: matches with sections, route groups and indicators are kept current batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stridelake.operators import sections as sec
from stridelake.operators.detection import DetectionConfig, signatures, step_lengths
from stridelake.operators.graph import ensure_checkpoint_dir
from stridelake.operators.spatial import kinds, line_digests
from stridelake.operators.upkeep import regrouped, spans
from stridelake.sources.folders import BucketTable

POINTS = "track_id long, sport_type string, seq int, t long, lat double, lng double"
LEAST_FIXES = 3


class SharedTable(BucketTable):
    """A table of sections whose stored rows stand for all sections of a kind: its key is the kind's smallest section_id."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, members: Callable[[], DataFrame]):
        super().__init__(spark, path, key, schema)
        self.members = members

    def stored(self) -> DataFrame:
        """The rows of kinds."""
        return super().read()

    def expanded(self, rows: DataFrame) -> DataFrame:
        """Rows of kinds as rows of sections. What can be joined to a kind's rows should be joined before."""
        m = self.members().select(F.col("section_id").alias("_member"), F.col("kind").alias("_kind"))
        return rows.join(m.hint("merge"), F.col(self.key) == F.col("_kind")).select(*(F.col("_member").alias(c) if c == self.key else c for c in rows.columns))

    def read(self) -> DataFrame:
        """All rows of all sections."""
        return self.expanded(self.stored())


class TrackIndex:
    """Stored tables of signatures, groups, traversals and indicators over a fixed set of sections.

    A batch holds whole tracks (POINTS). Indexing it matches its tracks with
    the sections of their sport, puts their traversals in the place of any
    that they had, regroups what the batch can change, and computes the
    indicators of the sections that it touches. The tables are then those of
    an index over all tracks seen, with the last version of each, so a batch
    that is run again changes nothing. New sections wait for the next
    detection. A track of fewer than three fixes has no rows, also if it had
    more before.

    Writes touch the buckets of the batch's tracks and sections only. Groups
    are compared by signatures, a row for each track. Sections of equal
    polyline, sport and length have equal rows: the first of such a kind is
    matched and stored, and read() gives the rows of all.
    """

    def __init__(self, spark: SparkSession, path: str, sections: DataFrame, polylines: DataFrame, cfg: DetectionConfig, threshold_m: float = 50.0, least: float = 0.5):
        ensure_checkpoint_dir(spark)
        self.spark, self.sections, self.polylines, self.cfg, self.threshold_m, self.least = spark, sections, polylines, cfg, threshold_m, least
        table = lambda name, key, schema: BucketTable(spark, f"{path}/{name}", key, schema)
        self.signatures = table("signatures", "track_id", "track_id long, lat double, lng double, end_lat double, end_lng double, metres_long double, points long, start long, elapsed long")
        self.groups = table("groups", "track_id", "track_id long, route long")
        shared = lambda name, schema: SharedTable(spark, f"{path}/{name}", "section_id", schema, lambda: self._kinds)
        self.traversals = shared(
            "traversals", "section_id long, activity_id long, start_index int, end_index int, direction string, distance_meters double, lap_time double, lap_pace double"
        )
        #: The sections (first of their kind) of each track, so that a track that comes again is found in all of them.
        self.visited = table("visited", "track_id", "track_id long, section_id long")
        self.indicators = shared("indicators", "activity_id long, kind string, section_id long, direction string, value int, lap_time double")

    @cached_property
    def _kinds(self) -> DataFrame:
        """The kind of each section."""
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
        s = self.sections.select("section_id", text("sport_type"), text("section_meters")).join(line_digests(self.polylines).hint("merge"), "section_id")
        return kinds(s, "section_id", "line", "sport_type", "section_meters")[1].checkpoint()

    @cached_property
    def _lines(self) -> DataFrame:
        """Polylines of the first section of each kind."""
        firsts = self._kinds.filter("section_id = kind").select("section_id")
        return self.polylines.join(firsts.hint("merge"), "section_id", "left_semi").checkpoint()

    def traversals_of(self, points: DataFrame) -> DataFrame:
        """Traversals of the tracks on the first section of each kind of their sport, with length, time and pace of each."""
        sport = points.groupBy("track_id").agg(F.first("sport_type").alias("sport_type"))
        found = spans(points.select("track_id", "seq", "lat", "lng"), self._lines, self.threshold_m, self.least)
        ours = self.sections.select("section_id", F.col("sport_type").alias("section_sport"))
        found = found.join(sport.hint("merge"), "track_id").join(ours.hint("merge"), "section_id").filter("sport_type = section_sport")
        steps = step_lengths(points.select("track_id", "seq", "t", "lat", "lng")).select("track_id", "seq", "t", "step")
        rows = found.join(steps.hint("merge"), "track_id").filter(F.col("seq").between(F.col("first"), F.col("last")))
        rows = rows.groupBy("section_id", F.col("track_id").alias("activity_id"), F.col("first").alias("start_index"), F.col("last").alias("end_index"), "direction").agg(
            F.round(F.sum(F.when(F.col("seq") > F.col("first"), F.col("step")).otherwise(0.0)), 3).alias("distance_meters"), (F.max("t") - F.min("t")).alias("s")
        )
        lap = F.when(F.col("s") > 0, F.col("s").cast("double"))
        return rows.select("*", lap.alias("lap_time"), F.round(F.col("distance_meters") / lap, 6).alias("lap_pace")).drop("s")

    def index(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Index a batch of whole tracks; fits foreachBatch."""
        good = batch.filter("lat is not null and lng is not null and track_id is not null")
        sizes = good.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FIXES)
        points = good.join(sizes.select("track_id"), "track_id", "left_semi").checkpoint()
        tracks = batch.filter("track_id is not null").select("track_id").distinct().checkpoint()
        if tracks.isEmpty():
            return
        new = self.traversals_of(points).checkpoint()
        before = self.visited.rows_of(tracks)
        touched = before.select("section_id").unionByName(new.select("section_id")).distinct().checkpoint()
        others = self.traversals.rows_of(touched).join(tracks.withColumnRenamed("track_id", "activity_id"), "activity_id", "left_anti")
        rows = others.unionByName(new, allowMissingColumns=True).checkpoint()

        times = points.groupBy("track_id").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("elapsed"))
        self.signatures.replace(tracks, signatures(points).join(times, "track_id"))
        self._regroup(tracks)
        self.traversals.replace(touched, rows)
        self.visited.replace(tracks, new.select(F.col("activity_id").alias("track_id"), "section_id").distinct())
        self.indicators.replace(touched, self._indicators(rows))

    def _regroup(self, tracks: DataFrame) -> None:
        """Groups that held a track of the batch are made anew; others can only grow."""
        now = self.groups.read()
        broken = now.join(tracks, "track_id", "left_semi").select("route").distinct()
        kept = now.join(broken, "route", "left_anti").select("track_id", "route")
        found = regrouped(self.signatures.read(), kept, self.cfg).checkpoint()
        changed = found.join(now, ["track_id", "route"], "left_anti").checkpoint()
        self.groups.replace(changed.select("track_id").unionByName(tracks), found.join(tracks, "track_id", "left_semi").unionByName(changed).distinct())

    def _indicators(self, rows: DataFrame) -> DataFrame:
        a = self.signatures.read().select(F.col("track_id").alias("activity_id"), F.col("start").alias("start_date"), F.col("metres_long").alias("distance_meters"), F.col("elapsed").alias("duration_secs"))
        return sec.indicators(sec.timed(rows.withColumn("excluded", F.lit(False)), self.sections, a))

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Index a stream of whole tracks, one micro-batch at a time; a batch that failed half-way is run again as a whole."""
        return stream.writeStream.foreachBatch(self.index).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
