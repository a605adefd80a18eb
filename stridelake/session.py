"""Session settings for stand-alone use; a cluster's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "stridelake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution and RocksDB state; partitions default to the cluster's own setting."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", partitions)
    return b.getOrCreate()
