"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch, join_checked, text_or_empty

BUCKETS, BUDGET, CHUNK_ROWS = 16, 131_072, 20_000


def optimal_boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries (from ascending distinct sizes) with the least padding.

    Dynamic programming over the histogram: best[j], the least padding of the
    first j sizes in the buckets so far. The padding of sizes i..j in one
    bucket satisfies the quadrangle inequality, so the best split moves only
    right as j grows. Each layer is found by halving, all segments of one
    depth at once: O(buckets * sizes * log) in integers, so the result is exact.
    """
    m = len(sizes)
    n, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes * counts)])

    def cost(i, j):  # sizes i..j-1 in a bucket of size sizes[j-1]
        return sizes[j - 1] * (n[j] - n[i]) - (t[j] - t[i])

    best = np.concatenate([[0], cost(0, np.arange(1, m + 1))])
    cuts = []
    for _ in range(1, min(buckets, m)):
        nxt, cut = best.copy(), np.zeros(m + 1, dtype=np.int32)
        lo, hi, a, b = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            width = np.minimum(b, j - 1) - a + 1
            starts = np.cumsum(width) - width
            i = np.arange(width.sum()) - np.repeat(starts - a, width)
            c = best[i] + cost(i, np.repeat(j, width))
            least = np.minimum.reduceat(c, starts)
            at = np.flatnonzero(c == np.repeat(least, width))
            at = at[np.searchsorted(at, starts)]
            nxt[j], cut[j] = least, i[at]
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, i[at]), (i[at], b)))
            keep = lo <= hi
            lo, hi, a, b = lo[keep], hi[keep], a[keep], b[keep]
        cuts.append(cut)
        best = nxt
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(sizes[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        out.append(int(sizes[j - 1]))
    return sorted(out)


def byte_length(text: str = "text") -> F.Column:
    """UTF-8 bytes of a text: its tokens under a byte vocabulary, and no fewer than its tokens under byte-level merges."""
    return F.octet_length(text_or_empty(text)).cast("long")


def pack_batches(docs: DataFrame, key: str = "doc_id", length: F.Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding for every row of docs.

    The length of a row in tokens is the given column (null: zero), or the
    bytes of its text. Dynamic programming over the global length histogram
    places the bucket boundaries with the least padding in total. In a bucket
    of boundary b, batches hold floor(budget / b) rows (one, where b exceeds
    the budget: no text is cut or dropped); all but a bucket's last batch are
    full. Batches are numbered bucket after bucket. A row of length zero (null
    or empty text) goes to the first bucket. Rows with equal keys get
    different slots. Empty input gives no rows.

    The driver gets the histogram of exact lengths. k distinct lengths add up
    to k**2 / 2 tokens at least, so of a corpus of n tokens it has
    sqrt(2 * n) rows at most: 45,000 for a billion, seven million for 25
    trillion.

    Row numbers need no task that sees a whole bucket: a bucket is dealt into
    chunks of about CHUNK_ROWS rows by the hash of the key, numbered within,
    and offset by a running sum over the small table of chunks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    n_tokens = F.coalesce((byte_length() if length is None else length).cast("long"), F.lit(0))
    lengths = scratch.save(docs.select(F.col(key).cast("long").alias("doc_id"), n_tokens.alias("n_tokens")), "lengths")
    hist = lengths.groupBy(F.col("n_tokens").alias("size")).agg(F.count(F.lit(1)).alias("rows")).toArrow()
    size, n = (hist.column(c).to_numpy().astype(np.int64) for c in ("size", "rows"))
    order = np.argsort(size)
    size, n = size[order], n[order]
    bounds = optimal_boundaries(size, n, buckets) if len(size) else [1]
    # Rows of each bucket, from the same histogram: at most `buckets` figures.
    edges = np.searchsorted(size, bounds, side="right")
    in_bucket = [int(x) for x in np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(n)])[edges]]))]
    caps = [max(1, budget // max(b, 1)) for b in bounds]
    first = np.concatenate([[0], np.cumsum([-(-n // c) for n, c in zip(in_bucket, caps)])])[:-1]
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(int(v)).cast(kind) for v in values)), F.col("bucket") + 1)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    spread = [max(1, -(-n // CHUNK_ROWS)) for n in in_bucket]
    salt = F.xxhash64("doc_id", "n_tokens", F.monotonically_increasing_id())
    placed = lengths.withColumn("bucket", bucket).withColumn("chunk", F.pmod(salt, pick(spread, "long")))
    placed = scratch.save(placed, "placed")
    scratch.drop(lengths)
    chunks = placed.groupBy("bucket", "chunk").count()
    offsets = chunks.withColumn("offset", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = scratch.save(offsets.drop("count"), "offsets")
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens")))
    at = F.col("offset") + F.col("n") - 1
    return join_checked(numbered, offsets, ["bucket", "chunk"], "inner").select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), pick(bounds, "long").alias("bucket_tokens"),
        (pick(first, "long") + F.floor(at / pick(caps, "long"))).cast("long").alias("batch"),
        F.pmod(at, pick(caps, "long")).cast("int").alias("slot"),
        (pick(bounds, "long") - F.col("n_tokens")).alias("padding"),
    )
