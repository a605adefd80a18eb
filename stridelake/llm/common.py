"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A side of a join is broadcast only if the stored table has at most this many bytes of keys and values.
BROADCAST_BYTES = 8 << 20
#: Bytes that a task of a shuffle of whole texts is given, about; adaptive execution still splits hot keys and joins small partitions.
TASK_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder of its
    own; on a cluster that is an error, since executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator run, written as Parquet to the shared folder.

    A stored table cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and every later reference sees the same rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self.close)

    def close(self) -> None:
        """Delete all tables of the run; at the driver's exit at the latest, as results may be read until then."""
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            hadoop_delete(self.spark, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._read(df, path)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """A further read of a stored table, whose columns Spark tells apart from those of the first."""
        return self._read(df, df._scratch_path)  # type: ignore[attr-defined]

    def drop(self, df: DataFrame) -> None:
        """Delete a stored table that no later plan reads."""
        hadoop_delete(self.spark, df._scratch_path)  # type: ignore[attr-defined]


def hadoop_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _values(kind: DataType) -> int:
    """Single values of a type: those of all its fields if it is a struct."""
    return sum(_values(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else 1


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored table in memory, about: its strings and binaries, 16 for each single value and 32 for each row."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    row = sum(wide, F.lit(16 * _values(df.schema) + 32))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def checked(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its bytes are few enough, else for a sort-merge join.

    Adaptive execution can split a sort-merge join where one key is hot.
    """
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df.hint("merge")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a stored table on the right, see checked()."""
    return left.join(checked(right), on, how)


@contextlib.contextmanager
def shuffle_tasks(spark: SparkSession, size: int):
    """Shuffles that run inside have a partition for each TASK_BYTES of `size`, and no fewer than are set."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(was), -(-size // TASK_BYTES))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its names."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _reads_files(docs: DataFrame) -> bool:
    """Whether docs is a file scan with filters and projections at most, so that no row of a file occurs twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Filter", "Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt over all task slots, if it is a scan of fewer splits than these; else df itself.

    Work on whole texts is heavy, and a file of one row group is one task. A
    table of many files or row groups is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if _reads_files(df) and df.rdd.getNumPartitions() < slots else df


def with_row(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a further column that tells each row apart from all others, and that column's name.

    Rows of files are named by file and place within it; these do not change
    when a task runs again. Rows of anything else are numbered and stored.
    """
    name = free_name(docs, "_row")
    if _reads_files(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            rows = docs.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")))
            rows.schema  # an unknown column fails here
            return rows, name
        except AnalysisException:  # not a file: there is no such column
            pass
    numbered = docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")))
    return scratch.save(numbered, "rows"), name


def without_rows(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """rows but for those whose `row` is in dropped (a stored table of that one column), without that column."""
    gone = free_name(rows, "_gone")
    return rows.join(checked(dropped.select(F.col(row).alias(gone))), F.col(row) == F.col(gone), "left_anti").drop(row)
