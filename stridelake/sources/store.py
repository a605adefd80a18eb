"""Domain tables written once and read by all queries after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from stridelake.sources.adapters import Tables

#: Tables in the store, with the column that their files are ordered by, so that its ranges prune.
STORED = {"metrics": "date", "activities": "start_date", "sections": "section_id", "section_points": "section_id", "traversals": "section_id", "wellness": "date", "exercise_sets": "activity_id", "points": "track_id"}


def store(tables: Tables, path: str) -> StoredTables:
    """Write every domain table to path/<name>, sorted by range, and return them as read back."""
    for name, order in STORED.items():
        getattr(tables, name).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{path}/{name}")
    return StoredTables(tables.spark, tables.sf_dir, path)


class StoredTables(Tables):
    """The same tables as Tables, read from a store."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        super().__init__(spark, sf_dir)
        self.path = path


def _reader(name: str) -> property:
    return property(lambda self: self.spark.read.parquet(f"{self.path}/{name}"))


for _name in STORED:
    setattr(StoredTables, _name, _reader(_name))


def materialised(spark: SparkSession, path: str, version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of at least this version: as stored at path, else built and stored.

    Versions lie in folders of their own; an older one is not read.
    """
    at = f"{path}/version={version}"
    try:
        return spark.read.parquet(at)
    except AnalysisException:  # not there yet
        build().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
