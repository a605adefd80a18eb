"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a local session without one gets its own, a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b); root is the smallest node that can be reached.

    Each round takes the least label among neighbours, then the label's own
    label, so rounds grow with the logarithm of the longest path. Rounds are
    checkpointed; one count a round reaches the driver. Loops, repeats and
    nulls are allowed and add nothing.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.filter("a <> b")
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("root", "seen").alias("to"), F.col("root").alias("was"))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = step.join(hop, "to", "left").select("node", F.least("to", "next").alias("root"), "was").checkpoint()
        if jumped.filter("root <> was").isEmpty():
            return labels
        labels = jumped.select("node", "root")
