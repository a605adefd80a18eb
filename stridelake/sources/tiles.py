"""A store of heatmap tiles that is kept current: markers of what changed, a version of the format, tiles drawn anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import heatmap
from stridelake.operators.graph import ensure_checkpoint_dir
from stridelake.sources.folders import delete

#: Version of the tiles' look; tiles of another version are drawn anew.
FORMAT = "1"
TILE = ["z", "x", "y"]


class TileStore:
    """Tiles path/z/x/y.png of all tracks (points: track_id, seq, lat, lng), for any store that Spark and pyarrow know.

    Who adds or removes tracks marks them; refresh() then draws the tiles that
    they touch, from all tracks that reach into these, and leaves the others
    alone. Without a version, or with another one, all tiles are drawn. A
    marker goes once its tiles are drawn, so a refresh that failed half-way
    is done again by the next.
    """

    def __init__(self, spark: SparkSession, path: str, zooms: list[int], version: str = FORMAT):
        ensure_checkpoint_dir(spark)
        self.spark, self.path, self.zooms, self.version = spark, path.rstrip("/"), zooms, version

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _stored_version(self) -> str | None:
        fs, p = self._fs("_version")
        return fs.listStatus(p)[0].getPath().getName() if fs.exists(p) and len(fs.listStatus(p)) else None

    def _markers(self) -> list[str]:
        fs, p = self._fs("_dirty")
        return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []

    def is_dirty(self) -> bool:
        return self._stored_version() != self.version or bool(self._markers())

    def mark(self, points: DataFrame) -> None:
        """Mark the tiles that some tracks touch, and those beside them; for tracks that were added, changed (once before, once after) or removed."""
        tiles = heatmap.tile_plan(points, self.zooms).select(*TILE)
        tiles.write.parquet(f"{self.path}/_dirty/{uuid.uuid4().hex}")

    def refresh(self, points: DataFrame) -> int:
        """Draw what is stale, and return the number of tiles that were drawn or removed."""
        markers = self._markers()
        if self._stored_version() != self.version:
            delete(self.spark, self.path)
            markers = []
            stale = heatmap.tile_plan(points, self.zooms).select(*TILE).checkpoint()
            some = points
        elif not markers:
            return 0
        else:
            stale = self.spark.read.parquet(*markers).distinct().checkpoint()
            near = heatmap.with_halo(heatmap.line_tiles(points, self.zooms)).join(stale, TILE, "left_semi").select("track_id").distinct()
            some = points.join(near, "track_id", "left_semi")
        pixels = heatmap.pixel_intensity(some, self.zooms).join(stale, TILE, "left_semi").checkpoint()
        heatmap.write_tiles(heatmap.rendered(pixels), self.path)
        remove_tiles(stale.join(pixels.select(*TILE).distinct(), TILE, "left_anti"), self.path)
        n = stale.count()
        fs, p = self._fs(f"_version/{self.version}")
        fs.mkdirs(p)
        for m in markers:
            delete(self.spark, m)
        return n


def remove_tiles(tiles: DataFrame, path: str) -> None:
    """Remove the files of tiles (z, x, y), where there are any; the tasks remove."""

    def drop(rows):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path)
        for r in rows:
            name = f"{root}/{r['z']}/{r['x']}/{r['y']}.png"
            if fs.get_file_info(name).type == pafs.FileType.File:
                fs.delete_file(name)

    tiles.select(*(F.col(c) for c in TILE)).foreachPartition(drop)
