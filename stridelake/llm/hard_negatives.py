"""Hard-negative mining by Kronecker-packed products.

Components are integers. The components of several candidates, shifted to be
non-negative, sit in separate bit fields of one wide integer; one product with
an anchor's component and one addition serve all of them, and exact scores are
read out of the fields of the sum. A field is as wide as the largest sum that
it can hold, so no carry reaches its neighbour. Where two or more fields fit
into 53 bits, the wide integer is the significand of a double, exact below
2**53, so that the sums of products are a matrix product; wider components are
packed into Python integers, a field for each candidate.

Anchors and rows are dealt into blocks, and each pair of blocks is one group
of a cogrouped job, so a task holds one block of either. The first job keeps
each anchor's best rows of its own label (its positives); the second keeps,
for each positive, the best rows of other labels within its score window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch

#: Bytes that a block of vectors has at most as doubles, anchors scored at once, and blocks of rows a task slot has at least.
BLOCK_BYTES, STRIPE, BLOCKS_PER_SLOT = 16 << 20, 64, 4
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
LONG = 2**63 - 1
PARTIAL = "anchor long, positive int, row long, vec_id long, score long"


NOTHING = pa.table({n: pa.array([], pa.int32() if n == "positive" else pa.int64()) for n in ("anchor", "positive", "row", "vec_id", "score")})


class Packed:
    """Inner products of integer rows of a with integer rows of b as int64; exact, and held at the ends of 63 bits beyond them.

    a . b = (a - x) . (b - y) + x . b + a . y - x . y, with x and y the least
    component of either side in each dimension; the first term is the packed one.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n = len(b)
        self.fields = 0
        if not a.size or not b.size:
            self.anchors, self.rest = None, np.zeros((len(a), len(b)), np.int64)
            return
        reach = [max(1, int(m.max()), -int(m.min())) for m in (a, b)]
        if a.shape[1] * reach[0] * reach[1] >= 2**61:
            a, b = a.astype(object), b.astype(object)
        x, y = a.min(axis=0), b.min(axis=0)
        self.anchors, packed = a - x, b - y
        self.of_row, self.of_anchor = b.dot(x) - x.dot(y), a.dot(y)
        most = sum(int(p) * int(q) for p, q in zip(self.anchors.max(axis=0), packed.max(axis=0)))
        self.width = max(1, most.bit_length(), int(packed.max()).bit_length())
        if (fields := 53 // self.width) >= 2 and a.dtype != object:
            rows = -(-self.n // fields)
            padded = np.zeros((rows * fields, b.shape[1]))
            padded[: self.n] = packed
            self.wide = np.ascontiguousarray(sum(padded[k * rows : (k + 1) * rows] * 2.0 ** (self.width * k) for k in range(fields)).T)
            self.anchors, self.fields = self.anchors.astype(np.float64), fields
        else:
            self.size = -(-self.width // 8)
            self.wide = [int.from_bytes(b"".join(int(v).to_bytes(self.size, "little") for v in column), "little") for column in packed.T]

    def scores(self, some: slice) -> np.ndarray:
        """Scores of some anchors, a line each."""
        if self.anchors is None:
            return self.rest[some]
        anchors = self.anchors[some]
        rest = self.of_row[None, :] + self.of_anchor[some][:, None]
        if self.fields:
            sums, parts, base = anchors @ self.wide, [], 2.0**self.width
            for _ in range(self.fields):  # the lowest field is what a division by 2**width leaves over
                above = np.floor(sums / base)
                parts.append(sums - above * base)
                sums = above
            return np.concatenate(parts, axis=1)[:, : self.n].astype(np.int64) + rest
        out = np.empty((len(anchors), self.n), object)
        for i, components in enumerate(anchors):
            sums = sum(int(c) * w for c, w in zip(components, self.wide)).to_bytes(self.size * self.n, "little")
            out[i] = [int.from_bytes(sums[k : k + self.size], "little") for k in range(0, len(sums), self.size)]
        return np.clip(out + rest, -LONG - 1, LONG).astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, short ones filled with zeros."""
    column = column.combine_chunks()
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class _Block:
    """One block of vectors, in the order of ties: by vec_id (nulls last), then by row number."""

    def __init__(self, t: pa.Table, width: int):
        ids = t["vec_id"]
        t = t.take(np.lexsort((t["row"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())))
        self.row, self.label, self.vec_id = t["row"].to_numpy(), t["label"].to_numpy(), t["vec_id"].combine_chunks()
        self.vectors = _matrix(t["q"], width)
        self.windows = t["windows"].to_pylist() if "windows" in t.column_names else []

    def table(self, anchors: list, positives: list, places: list, scores: list) -> pa.Table:
        places = np.array(places, np.int64)
        return pa.table({
            "anchor": np.array(anchors, np.int64), "positive": np.array(positives, np.int32), "row": self.row[places],
            "vec_id": self.vec_id.take(pa.array(places)), "score": np.array(scores, np.int64),
        })


def _best_positives(width: int):
    """Of a block of anchors and one of rows, each anchor's best other rows of its label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return NOTHING
        a, b, out = _Block(anchors, width), _Block(rows, width), ([], [], [], [])
        for x in np.unique(a.label):
            mine, theirs = np.flatnonzero(a.label == x), np.flatnonzero(b.label == x)
            packed = Packed(a.vectors[mine], b.vectors[theirs])
            for k in range(0, len(mine), STRIPE):
                for i, s in zip(mine[k : k + STRIPE], packed.scores(slice(k, k + STRIPE))):
                    fit = np.flatnonzero(b.row[theirs] != a.row[i])
                    if len(fit) > POSITIVES:  # all that reach the last of the best
                        fit = fit[s[fit] >= np.partition(s[fit], -POSITIVES)[-POSITIVES]]
                    best = fit[np.argsort(~s[fit], kind="stable")][:POSITIVES]
                    for column, new in zip(out, ([a.row[i]] * len(best), [0] * len(best), theirs[best], s[best])):
                        column.extend(new)
        return b.table(*out)

    return run


def _best_negatives(width: int):
    """Of a block of anchors with their windows of scores and one of rows, the best rows of other labels in each window."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return NOTHING
        a, b, out = _Block(anchors, width), _Block(rows, width), ([], [], [], [])
        packed = Packed(a.vectors, b.vectors)
        for k in range(0, len(a.row), STRIPE):
            for i, s in enumerate(packed.scores(slice(k, k + STRIPE)), k):
                spans = [(w["positive"], -(-LOW * w["score"] // 100), HIGH * w["score"] // 100) for w in a.windows[i]]
                spans = [w for w in spans if w[1] <= w[2]]
                if not spans:
                    continue
                fit = np.flatnonzero((s >= min(w[1] for w in spans)) & (s <= max(w[2] for w in spans)) & (b.label != a.label[i]))
                fit = fit[np.argsort(~s[fit], kind="stable")]  # ~s falls as s rises, and no score is too small for it
                falling = ~s[fit]
                for positive, low, high in spans:
                    first = np.searchsorted(falling, ~high)
                    best = fit[first : first + NEGATIVES]
                    best = best[s[best] >= low]
                    for column, new in zip(out, ([a.row[i]] * len(best), [positive] * len(best), best, s[best])):
                        column.extend(new)
        return b.table(*out)

    return run


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key by score, then by vec_id, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Rows with a null label or vector, or with a null or non-finite component,
    take no part. Where the key is divisible by 7, the label becomes
    (label + 1) % 10. Components are floor(256 * x); of vectors of unequal
    length the missing ones are zero. A score is an integer inner product
    (beyond 63 bits, the end of that range). Anchors are the rows whose key is
    divisible by 50. An anchor's positives are its best 5 other rows of the
    same label, all if fewer; each gets the best 3 rows of other labels whose
    score is 50 to 95 % of its own, all if fewer. Higher scores come first,
    ties by smaller key (nulls last).

    Repeated rows are rows of their own: an anchor's copy can be its positive,
    and each copy of an anchor has its own rows in the result. A null key is
    no anchor. Other columns are ignored; empty input gives no rows.

    Vectors are stored once with a number each. Blocks of rows meet blocks of
    anchors by a shuffle; vectors cross it once for each block of the other
    side. Blocks are bounded in bytes, so a task's memory is, too; each anchor
    brings at most 5, then 15 rows from a block to the final ranking.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    name, x = F.col(key).cast("long"), F.col(vector)
    usable = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    of = F.col(label).cast("long")
    rows = scratch.save(
        vectors.filter(usable).select(
            F.monotonically_increasing_id().alias("row"), name.alias("vec_id"), F.when(name % 7 == 0, (of + 1) % 10).otherwise(of).alias("label"),
            F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("q"),
        ),
        "vectors",
    )
    anchors = scratch.again(rows).filter("vec_id % 50 = 0")  # a read of its own: a cogroup mixes up columns of one read
    n, m, width = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % 50 == 0, 1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    block = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    of_rows, of_anchors = max(-(-n // block), BLOCKS_PER_SLOT * spark.sparkContext.defaultParallelism), max(1, -(-m // block))

    def dealt(df: DataFrame, own: int, other: int, own_step: int, other_step: int) -> DataFrame:
        """df with a copy of each row in each cell of its block."""
        met = df.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
        return met.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(own)) * own_step + F.col("met") * other_step).drop("met")

    def scored(some: DataFrame, best) -> DataFrame:
        left, right = dealt(some, of_anchors, of_rows, of_rows, 1), dealt(rows, of_rows, of_anchors, 1, of_rows)
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(best(width), PARTIAL)

    positives = scratch.save(_first(scored(anchors, _best_positives), ["anchor"], POSITIVES).select("anchor", F.col("rank").alias("positive"), "vec_id", "score"), "positives")
    windows = positives.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("windows"))
    wanted = scratch.save(anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    negatives = _first(scored(wanted, _best_negatives), ["anchor", "positive"], NEGATIVES)
    n, p, a = negatives.alias("n"), positives.alias("p"), anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).alias("a")
    return n.join(p, ["anchor", "positive"]).join(a, "anchor").select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score")
    )


def oracle_sql() -> str:
    """DuckDB SQL: every anchor against every row, scores as integers."""
    return """
        with v as (
            select row_number() over () id, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
                list_transform(embedding, lambda x: floor(256 * x::double)) q
            from embeddings
            where label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (
            select a.id anchor, a.vec_id anchor_id, r.id, r.vec_id, r.label = a.label same, list_inner_product(a.q, r.q)::bigint score
            from v a join v r on a.id <> r.id where a.vec_id % 50 = 0
        ),
        p as (select *, row_number() over (partition by anchor order by score desc, vec_id, id) positive from s where same qualify positive <= 5)
        select p.anchor_id, p.vec_id positive_id, row_number() over (partition by p.anchor, positive order by n.score desc, n.vec_id, n.id)::int "rank",
            n.vec_id negative_id, p.score positive_score, n.score negative_score
        from p join s n on n.anchor = p.anchor and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
        qualify "rank" <= 3
    """
