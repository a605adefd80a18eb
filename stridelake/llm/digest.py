"""Document fingerprints: quartile bucket digests, compared with a bounded difference score.

Byte triplets of a sliding five-byte window are hashed into 128 buckets. The
digest is the text's length class, two quartile ratios and, for each bucket,
the quartile in which its count lies.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stridelake.llm.common import Scratch, join_checked, text_or_empty

BUCKETS, WINDOW, STEP = 128, 5, 1 << 20
# Offsets back from the window's last byte of the other two bytes of each triplet.
TRIPLETS = [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]
LENGTH_CAP, RATIO_CAP = 96, 48
#: Bytes of a key range, one task each; larger where there would be more than MOST_RANGES of them.
RANGE_BYTES, MOST_RANGES, BINS = 6 << 20, 50_000, 2_000
#: Bits of the hash that cut a hot key at first, and further ones where a slot of these is still too large.
SLOT_BITS, MORE_BITS = 12, 6
MOST = 6 * BUCKETS + LENGTH_CAP + 2 * RATIO_CAP


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A permutation of the bytes, and for each triplet kind the hash of its first two bytes as a 65,536-entry table."""
    perm = np.random.RandomState(2024).permutation(256).astype(np.uint8)
    first = np.arange(256, dtype=np.uint8)
    pairs = [perm[perm[perm[k + 1] ^ first][:, None] ^ first[None, :]].reshape(-1) for k in range(len(TRIPLETS))]
    return perm, np.stack(pairs)


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets; long texts go block by block."""
    perm, pairs = _tables()
    counts = np.zeros(256, np.int64)
    for lo in range(0, max(len(data) - WINDOW + 1, 0), STEP):
        b = np.frombuffer(data, np.uint8, min(STEP + WINDOW - 1, len(data) - lo), lo)
        n = len(b) - WINDOW + 1
        at = lambda back: b[WINDOW - 1 - back : WINDOW - 1 - back + n]  # noqa: B023, E731
        wide = {back: at(0).astype(np.uint16) << 8 | at(back) for back in {x for x, _ in TRIPLETS}}
        for k, (x, y) in enumerate(TRIPLETS):
            counts += np.bincount(perm[pairs[k][wide[x]] ^ at(y)], minlength=256)
    return counts[:BUCKETS] + counts[BUCKETS:]


def digest(data: bytes) -> str:
    """Hex digest: length class and quartile ratios (a byte each half), then two bits a bucket. Defined for any length."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(int(round(8 * math.log2(len(data) + 1))), 255)
    ratios = (int(100 * q1 / q3) % 16, int(100 * q2 / q3) % 16) if q3 else (0, 0)
    body = np.packbits(np.unpackbits(codes[:, None], axis=1)[:, 6:])
    return bytes([length, ratios[0] << 4 | ratios[1]]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """Score from 0 (equal digests) to MOST: opposite quartiles weigh six, length and ratios up to their caps."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    codes = [np.packbits(np.pad(np.unpackbits(z[2:]).reshape(-1, 2), ((0, 0), (6, 0))), axis=1)[:, 0].astype(int) for z in (x, y)]
    gap = np.abs(codes[0] - codes[1])
    score = int(gap.sum()) + 3 * int((gap == 3).sum())
    score += min(3 * abs(int(x[0]) - int(y[0])), LENGTH_CAP)
    for shift in (4, 0):
        d = abs((int(x[1]) >> shift & 15) - (int(y[1]) >> shift & 15))
        score += min(6 * min(d, 16 - d), RATIO_CAP)
    return score


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MOST


def _pairs(batches) -> Iterator[tuple]:
    """(doc_id, text, next text) of sorted rows; the last row, the first of the range after, only serves as a next text."""
    last = None
    for b in batches:
        for row in zip(b.column(0), b.column(1)):
            doc_id, text = row[0].as_py(), row[1].as_py()
            if last is not None:
                yield (*last, text)
            last = (doc_id, text)


def _ranges(rows: DataFrame, range_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the ranges but the first, as positions and hashes, and how many ranges share each bound.

    Quantiles of the position cut the rows into at most BINS bins, whose
    bytes are summed. Bins are joined, or cut evenly, to ranges of about
    range_bytes; a bin of one position (a hot key) is cut by the hash of the
    text, by more and more of its bits where rows are many. Where one hash
    alone is too large (copies of one text under one key), it gets several
    ranges, between which its rows are dealt.
    """
    size = (F.octet_length("text") + 16).cast("long")
    sketch = rows.agg(F.percentile_approx("pos", [i / BINS for i in range(1, BINS)], 20_000).alias("q"), F.sum(size).alias("total")).first()
    if sketch["q"] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    target = max(range_bytes, sketch["total"] // MOST_RANGES)
    cuts = np.array(sorted(set(sketch["q"])), np.int64)

    @F.pandas_udf(LongType())
    def bin_of(pos):
        return pd.Series(np.searchsorted(cuts, pos.to_numpy(), side="right").astype(np.int64))

    bins = rows.groupBy(bin_of("pos").alias("bin")).agg(F.sum(size).alias("bytes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).orderBy("bin").collect()
    hot = [r["lo"] for r in bins if r["lo"] == r["hi"] and r["bytes"] > 2 * target]
    slots: dict[int, list[tuple[int, int, bool]]] = {}  # of each hot position: lowest hash, bytes, whether it is one hash
    cut, wide = SLOT_BITS, rows.filter(F.col("pos").isin(hot)).withColumn("prefix", F.lit(0).cast("long"))
    while hot:
        prefix = F.shiftright("h", 64 - cut)
        found = wide.groupBy("pos", prefix.alias("slot")).agg(F.sum(size).alias("bytes")).collect()
        large = {(r["pos"], r["slot"]) for r in found if r["bytes"] >= 2 * target and cut < 64}
        for r in found:
            if (r["pos"], r["slot"]) not in large:
                slots.setdefault(r["pos"], []).append((r["slot"] << 64 - cut, r["bytes"], cut == 64))
        if not large:
            break
        keys = rows.sparkSession.createDataFrame(sorted(large), "pos long, prefix long")
        wide = rows.withColumn("prefix", prefix).join(F.broadcast(keys), ["pos", "prefix"], "left_semi")
        cut = min(cut + MORE_BITS, 64)
    out, have = [], 0

    def piece(pos: int, h: int, n: int, one: bool = False):
        nonlocal have
        parts = n // target
        if one and parts > 1:
            out.append((pos, h, parts))
            have = target  # what follows starts a range of its own
            return
        if have + n > target and have:
            out.append((pos, h, 1))
            have = 0
        have += n

    for r in bins:
        if r["lo"] in slots:
            for h, n, one in sorted(slots[r["lo"]]):
                piece(r["lo"], h, n, one)
        else:
            k = min(max(1, -(-r["bytes"] // target)), r["hi"] - r["lo"] + 1)
            for i in range(k):
                piece(r["lo"] + (r["hi"] - r["lo"] + 1) * i // k, -(2**63), r["bytes"] // k)
    return tuple(np.array([x[i] for x in out], np.int64) for i in range(3))


def edited_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the row's own with its last floor(n / 2) code points
    replaced by the first as many of the next row by ascending key (after the
    last: the first). A null text counts as empty, null keys sort first, rows
    with equal keys follow by the hash of their texts, then by their texts. A
    lone row follows itself. Empty input gives no rows. Texts without a byte
    triplet that counts (under five bytes) have empty buckets: such texts of
    one length have likeness 1, whatever they say.

    One shuffle of the texts: rows go to ranges of (key, hash) of about equal
    bytes, one a task, and stream through it in order, two texts in memory at
    a time. The first row of each range, found beforehand, is also sent to the
    range before it.
    """
    scratch = Scratch(docs.sparkSession, "digest")
    t = text_or_empty(text)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("pos"), F.xxhash64(t).alias("h"), F.col(key).cast("long").alias("doc_id"), t.alias("text"))
    pos, slot, share = _ranges(rows, range_bytes)
    first = np.concatenate([[0], 1 + np.cumsum(share) - share]).astype(np.int64)  # number of the first range from each bound on
    shared = np.concatenate([[1], share]).astype(np.int64)
    n = int(first[-1] + shared[-1])

    @F.pandas_udf(LongType())
    def part_of(p, h, deal):
        p, h, deal = p.to_numpy(), h.to_numpy(), deal.to_numpy()
        at, upto = np.searchsorted(pos, p, side="left"), np.searchsorted(pos, p, side="right")
        for k in np.unique(at[at < upto]):  # keys that are bounds themselves: by hash
            mine = at == k
            at[mine & (at < upto)] += np.searchsorted(slot[k : upto[mine & (at < upto)][0]], h[mine & (at < upto)], side="right")
        return pd.Series(first[at] + deal % shared[at])

    placed = rows.withColumn("part", part_of("pos", "h", F.monotonically_increasing_id()))
    # First row of each range: the least of a number made of key and hash, then, of the few rows that have it, the least text.
    number = F.col("pos").cast("decimal(20,0)") * F.lit(2**60) + (F.shiftright("h", 4) + F.lit(2**59))
    least = scratch.save(placed.groupBy("part").agg(F.min(number).alias("least")), "least")
    heads = (
        join_checked(placed.withColumn("number", number), least, ["part"], "inner").filter("number = least")
        .groupBy("part").agg(F.min(F.struct("pos", "h", "text", "doc_id")).alias("head"))
    )
    # The range before: that of the next lower number that has rows; before the first: the last. One row a range, numbers only.
    everywhere = Window.partitionBy(F.lit(0))
    before = least.select("part", F.coalesce(F.lag("part").over(everywhere.orderBy("part")), F.max("part").over(everywhere)).alias("before"))
    extra = join_checked(heads, scratch.save(before, "before"), ["part"], "inner").select(
        F.col("before").alias("part"), F.lit(True).alias("extra"), "head.pos", "head.h", "head.text", "head.doc_id"
    )
    placed = (
        placed.select("part", F.lit(False).alias("extra"), "pos", "h", "text", "doc_id").unionByName(extra)
        .repartitionById(n, F.col("part").cast("int"))
        .sortWithinPartitions("part", "extra", "pos", "h", "text", "doc_id")
        .select("doc_id", "text")
    )

    def run(batches):
        out: list[tuple] = []
        memo: tuple[str | None, str] = (None, "")
        for doc_id, own, nxt in _pairs(batches):
            n = len(own)
            m = n // 2
            edited = (own[: n - m] + nxt[:m]).encode("utf-8")
            a = memo[1] if memo[0] == own else digest(own.encode("utf-8"))
            e, x = digest(edited), digest(nxt.encode("utf-8"))
            memo = (nxt, x)
            out.append((doc_id, n, hashlib.sha256(edited).hexdigest(), a, e, likeness(a, e), likeness(a, x)))
            if len(out) == 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
