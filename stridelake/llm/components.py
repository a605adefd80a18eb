"""Connected components of an edge table: union-find inside tasks, stars contracted between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch

#: Edges that one task may hold in a union-find (some 100 MB in Python); a table of so many needs no further round.
TASK_EDGES = 500_000


class Forest:
    """Union-find over integers; the root of a tree is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def add(self, a: int, b: int) -> bool:
        """Join the trees of a and b; False if they are one already."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Edges to stars (member, root) with the same components, a bounded number of edges at a time."""
    forest = Forest()

    def stars():
        nodes = list(forest.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.add(a, b)
        if len(forest.parent) > TASK_EDGES:
            yield stars()
            forest = Forest()
    if forest.parent:
        yield stars()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node of its component.

    Tasks first turn their edges into stars. While more than TASK_EDGES are
    left, a round of large-star and small-star contraction (two groupings, two
    joins) follows, and the tasks contract again; then one task, which holds
    that bounded rest, ends it. Each round's edges are stored, so lineage
    stays flat, and one figure a round reaches the driver. Loops and repeated
    edges are allowed; nulls are ignored.
    """
    now = scratch.save(edges.filter("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    while (n := now.count()) > TASK_EDGES:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt = scratch.save(small, "edges")
        done = nxt.groupBy("a").count().filter("count > 1").isEmpty() and nxt.join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        scratch.drop(now)
        now = nxt
        if done:  # stars already
            break
        nxt = scratch.save(now.repartition("b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
        scratch.drop(now)
        now = nxt
    else:
        if n:
            nxt = scratch.save(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "edges")
            scratch.drop(now)
            now = nxt
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
