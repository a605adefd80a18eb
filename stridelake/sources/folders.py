"""Folders that the driver and all executors share, and tables in them of which parts are replaced."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class BucketTable:
    """A table whose rows lie in buckets of a key, so that a change rewrites the buckets of the keys that it touches.

    A rewrite is stored beside the table first and then copied over its
    buckets. It is the same however often it is done, so a batch that fails
    in between is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """All rows; none if nothing was written yet."""
        try:
            return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).drop("bucket")
        except AnalysisException:  # not there yet
            return self.spark.createDataFrame([], self.schema)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows of some keys; only their buckets are read."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return rows.filter(F.col("bucket").isin(self._touched(keys))).drop("bucket").join(keys.select(self.key), self.key, "left_semi")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: at most as many numbers as there are buckets reach the driver."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """Put rows in the place of all rows of some keys (key column; those of rows must be among them)."""
        touched = self._touched(keys)
        if not touched:
            return
        order = [c.split()[0] for c in self.schema.split(", ")]
        try:
            now = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
            kept = now.join(keys.select(self.key).distinct(), self.key, "left_anti")
        except AnalysisException:
            kept = self.spark.createDataFrame([], self.schema)
        staged = f"{self.path}.next-{uuid.uuid4().hex[:12]}"
        kept.select(order).unionByName(rows.select(order)).withColumn("bucket", self.bucket()).write.parquet(staged)
        new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(staged)
        # Buckets that end up empty must go, too: overwriting by partition leaves those alone that have no new row.
        filled = {r[0] for r in new.select("bucket").distinct().collect()}
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - filled:
            delete(self.spark, f"{self.path}/bucket={b}")
        delete(self.spark, staged)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
