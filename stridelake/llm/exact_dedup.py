"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their leading bytes, then each group that still has
two or more members by its next bytes, and so on until a group is a singleton
or its members have ended. A digit is a run of bytes whose width grows by a
factor from level to level, so a text of n bytes needs O(log n) levels. Texts
are compared byte by byte: no digest decides equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch, shuffle_tasks, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DIGIT, GROWTH = 32, 8


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() does just that to text of single bytes, and is many times faster."""
    each = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), UPPER, text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(each)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Equal: identical after lower-casing A-Z. The largest key of a group stays.
    A null text counts as empty; all empty texts are one group. A null key
    sorts below all others. Rows that repeat both key and text share a
    verdict, unless `row` names a column that tells rows apart: then it is
    returned too, and of such rows the largest is kept alone. Empty input
    gives no rows; other columns are ignored.

    Members are counted by (group, digit) with map-side partial aggregation,
    so a hot group is a few rows a task; then rows move to their digit, with
    the bytes not yet read, in a sort-merge join that adaptive execution
    splits where a digit is hot, in as many tasks as the bytes need. The split of a level is stored once: rows
    that are done with their verdict, the others with the rest of their
    bytes, from which the next level reads.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    name = F.struct(F.col(key).cast("long").alias("id"), (F.col(row) if row else F.lit(0)).alias("row"))
    norm = F.encode(ascii_lower(text_or_empty(text)), "utf-8")
    rows = docs.select(name.alias("who"), F.lit(0).cast("long").alias("gid"), norm.alias("rest"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    # To count the first level, leading characters are enough.
    head = F.encode(ascii_lower(F.substring(text_or_empty(text), 1, FIRST_DIGIT + 1)), "utf-8")
    size = Observation()
    heads = docs.observe(size, F.coalesce(F.sum(F.octet_length(text_or_empty(text)).cast("long") + 100), F.lit(0)).alias("bytes")).select(name.alias("who"), F.lit(0).cast("long").alias("gid"), head.alias("rest"))
    width, levels = FIRST_DIGIT, []
    while True:
        digit = [F.substring("rest", 1, width).alias("digit"), (F.octet_length("rest") <= width).alias("ended")]
        groups = scratch.save(
            heads.select("who", "gid", *digit)
            .groupBy("gid", "digit", "ended")
            .agg(F.max("who").alias("keep"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1")
            .withColumn("next_gid", F.when(~F.col("ended"), F.monotonically_increasing_id())),
            "groups",
        )
        more = not groups.filter("not ended").isEmpty()
        # Rows move to their digits in one shuffle at every size: digits of all groups have no bound that a broadcast needs.
        split = rows.select("who", "sha", "gid", *digit, *([F.expr(f"substring(rest, {width + 1})").alias("tail")] * more)).join(
            groups.hint("merge"), ["gid", "digit", "ended"], "left"
        )
        moved = split.select(
            "who", F.coalesce("keep", "who").alias("keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha", "next_gid",
            *([F.when(F.col("next_gid").isNotNull(), F.col("tail")).alias("tail")] * more),
        )
        with shuffle_tasks(scratch.spark, size.get["bytes"]):
            last = scratch.save(moved, "split")
        levels.append(last.filter("next_gid is null").select("who", "keep", "group_size", "sha"))
        scratch.drop(groups)
        if not more:
            break
        rows = heads = last.filter("next_gid is not null").select("who", "sha", F.col("next_gid").alias("gid"), F.col("tail").alias("rest"))
        width *= GROWTH
    return reduce(DataFrame.unionByName, levels).select(
        F.col("who.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", F.col("who").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), *([F.col("who.row").alias(row)] if row else []),
    )
