"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum
is taken in linear time as half of (sum v x)^2 - sum v^2 x^2.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stridelake.llm.common import free_name, spread, text_or_empty

WORDS, BINS, RANK = 1 << 12, 16, 8
#: Labelled rows that the model is fitted on, at most (those with the smallest hash of their key).
TRAIN_ROWS = 6000
THRESHOLD = 0.3
MEMO = 50_000

_CLASSES = np.zeros(256, np.int64)
for _i, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"!?", b"|/\\_~<>", b"#%&*@$^+={}[]`", b" ", b"\n\r\t"], 1):
    _CLASSES[list(_set)] = _i
N_CLASSES = 11


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics between 0 and 1; all zero but the last for an empty text."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    by_byte = np.bincount(data, minlength=256)
    high = int(by_byte[128:].sum())
    c = np.bincount(_CLASSES, weights=by_byte, minlength=N_CLASSES)
    n, m = max(len(data), 1), max(len(words), 1)
    letters = max(c[1] + c[2] + high, 1)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    return [
        c[1] / letters, high / n, *(c[3:10] / n), (c[0] - high) / n, len(counts) / m, max(counts.values(), default=0) / m,
        pairs / max(len(words) - 1, 1), min((len(text) / m) / 32, 1), 1 - len(set(lines)) / max(len(lines), 1), min(len(words) / max(len(lines), 1) / 128, 1),
        # metadata: the text's length
        min(math.log2(len(text) + 1) / 24, 1),
    ]


N_STATS = 17
SIZE = WORDS + N_STATS * BINS


class Features:
    """Sparse features of a text: unit-length log counts of hashed words, and the bin of each statistic."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        at = np.empty(len(counts), np.int64)
        for k, w in enumerate(counts):
            if (i := memo.get(w)) is None:
                i = memo[w] = zlib.crc32(w.lower().encode("utf-8")) % WORDS
            at[k] = i
        x = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        idx, inv = np.unique(at, return_inverse=True)
        val = np.bincount(inv, weights=x, minlength=len(idx)) if len(idx) else np.empty(0)
        val = val / max(np.linalg.norm(val), 1e-9)
        stats = np.minimum(np.sqrt(np.maximum(statistics(text, words, counts), 0)) * BINS, BINS - 1).astype(np.int64)
        return np.concatenate([idx, WORDS + np.arange(N_STATS) * BINS + stats]), np.concatenate([val, np.full(N_STATS, 0.5)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[idx] * val[:, None]
        s = np.add.reduceat(vx, starts)
        pair = 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[idx] * val, starts) + pair, s

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        idx, val, starts = concat(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, starts)[0], -30, 30)))


def concat(rows):
    """Concatenated features; each row has at least its statistics, so no row is empty."""
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int | None = None, batch: int = 128, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
    """Log loss by Adagrad over shuffled batches; without rows, a model that scores one half.

    Ten epochs for a full sample, more (sixty at most) for a smaller one, so
    that it too gets enough steps.
    """
    epochs = epochs or int(min(60, max(10, 10 * TRAIN_ROWS / max(len(rows), 1))))
    rng = np.random.RandomState(seed)
    fm = FactorisationMachine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if not len(rows):
        fm.factors[:] = 0
        return fm
    p = min(max(y.mean(), 0.01), 0.99)
    fm.bias = math.log(p / (1 - p))
    g_lin, g_fac = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            idx, val, starts = concat([rows[i] for i in at])
            row = np.repeat(np.arange(len(at)), np.diff(np.append(starts, len(idx))))
            z, s = fm.raw(idx, val, starts)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            e = err[row] * val
            used, inv = np.unique(idx, return_inverse=True)
            lin = np.bincount(inv, weights=e) + decay * fm.linear[used]
            grad = e[:, None] * (s[row] - fm.factors[idx] * val[:, None])
            fac = np.stack([np.bincount(inv, weights=grad[:, k]) for k in range(RANK)], 1) + decay * fm.factors[used]
            g_lin[used] += lin**2
            g_fac[used] += fac**2
            fm.linear[used] -= rate * lin / np.sqrt(g_lin[used])
            fm.factors[used] -= rate * fac / np.sqrt(g_fac[used])
            fm.bias -= rate * err.sum()
    return fm


def held_out(key: F.Column) -> F.Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most `rows` labelled documents that are not held out.

    Labels that are null or have no document are left out. The sample is the
    labelled keys with the smallest hash, so it is the same in each run; its
    features (a bounded number of rows) are gathered to the driver.
    """
    picked = (
        labels.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("double").alias("_y"))
        .dropna().filter(~held_out(F.col("_key"))).groupBy("_key").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key").limit(rows)
    )
    # Of documents that share a key one is taken, so the sample is no larger than `picked`.
    sample = (
        docs.select(F.col(key).cast("long").alias("_key"), text_or_empty(text).alias("_text"))
        .join(F.broadcast(picked), "_key").groupBy("_key", "_y").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    )

    def run(batches):
        features = Features()
        for b in batches:
            found = [features.of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["key", "y", "idx", "val"],
            )

    got = sample.mapInArrow(run, "key long, y double, idx binary, val binary").collect()
    got.sort(key=lambda r: r["key"])
    return fit([(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(np.float64)) for r in got], np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score of the whole text as a further column (0 to 1).

    Map-only; the model has a fixed size. Null and empty texts get the score
    of their statistics. A column of docs that has the score's name is kept
    under `<name>_in`, or the next free name after it.
    """
    if name in docs.columns:
        docs = docs.withColumnRenamed(name, free_name(docs, f"{name}_in"))
    docs = spread(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    at = docs.columns.index(text)

    def run(batches):
        fm, features = FactorisationMachine(*shared.value), Features()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                s = fm.scores([features.of(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(np.float64))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows get equal scores, no rows give none."""
    model = train(docs, labels, key=key, text=text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged; without labels or rows to learn from, all of them."""
    name = free_name(docs, "_quality")
    return score(docs, train(docs, labels, text=text), text, name).filter(F.col(name) >= THRESHOLD).drop(name)
