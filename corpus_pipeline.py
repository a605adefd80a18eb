"""A corpus pipeline: quality filter, exact dedup, near dedup, packing. See STAGES.

Stages decide on rows, not on keys: rows that repeat a doc_id, or have none,
are judged each by its own text. A null text counts as empty, extra columns
pass through whatever their names, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import exact_dedup, jaccard, packing, quality, token_counts
from stridelake.llm.common import Scratch, with_row, without_rows
from stridelake.llm.queries import vocabulary_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on sf_dir's labels, accepts; without labels it accepts all."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the largest doc_id (null ones last; of rows that repeat it, any one)."""
    scratch = Scratch(spark, "exact")
    rows, row = with_row(docs, scratch)
    verdicts = exact_dedup.exact_duplicates(rows, row=row)
    return without_rows(rows, row, scratch.save(verdicts.filter("not kept").select(row), "dropped"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard >= 0.8), one row: that with the smallest doc_id."""
    scratch = Scratch(spark, "near")
    rows, row = with_row(docs, scratch)
    groups = jaccard.near_duplicates(rows, row=row)
    return without_rows(rows, row, scratch.save(groups.filter("not kept").select(row), "dropped"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left, a row for each; lengths are exact token counts."""
    counts = token_counts.token_counts(docs, vocabulary_path())
    return packing.pack_batches(counts, length=F.col("n_tokens"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted, which SQL cannot express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again; a stage's rows go once the next are stored."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
