"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.operators.graph import ensure_checkpoint_dir


def running(df: DataFrame, value: Column, name: str, *order: Column | str) -> DataFrame:
    """df with the sum of `value` over all rows up to and including each, in an order that tells all rows apart.

    Rows are put in order by ranges and kept (checkpoint), so that ranges stay
    as they are; each range sums up its own rows, and what comes before a
    range is a sum over one row for each.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.withColumn("_v", value.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    totals = cut.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = totals.select(F.col("_p").alias("_q"), (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))  # a row for each range
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_i", inside).join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col("_i") + F.col("_b")).drop("_v", "_p", "_q", "_b", "_i")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place, from 1, in an order that tells all rows apart."""
    return running(df, F.lit(1), name, *order)


def with_free_numbers(df: DataFrame, place: str, taken: DataFrame, name: str) -> DataFrame:
    """df with the place-th of the numbers 1, 2, 3 ... that `taken` (distinct, column n) leaves free.

    That number is the place plus the count of taken numbers t_i with
    t_i - i < place; one running sum over both tables gives the counts.
    """
    gaps = numbered(taken.filter("n > 0"), "i", "n").select((F.col("n") - F.col("i")).alias("at"), F.lit(1).alias("is_taken"), F.col("n").alias("tie"))
    asked = df.select(F.col(place).alias("at"), F.lit(0).alias("is_taken"), F.lit(0).cast("long").alias("tie"))
    counts = running(gaps.unionByName(asked), F.col("is_taken"), "below", "at", "is_taken", "tie").filter("is_taken = 0").select(F.col("at").alias("_at"), "below")
    return df.join(counts, F.col(place) == F.col("_at")).withColumn(name, F.col(place) + F.col("below")).drop("_at", "below")
