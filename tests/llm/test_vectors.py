"""Hard negatives against plain loops, with nulls, non-finite components, ties, repeated and very long vectors."""

import math
import random

import numpy as np
import pytest

from stridelake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor int, score double, cell int"


def plain(rows):
    v = []
    for n, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        v.append((n, i, label, [max(-(2**63), min(2**63 - 1, math.floor(256 * float(np.float32(c))))) for c in x]))
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b))))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, i, label, x in v:
        if i is None or i % 50:
            continue
        scored = [(dot(x, y), j, m) for k, j, m, y in v if k != n]
        for p, j, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            fit = sorted((r for r in scored if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p), key=order)[:3]
            out += [(i, j, k, r[1], p, r[0]) for k, r in enumerate(fit, 1)]
    return out


def vectors(n, dims, scale, rng):
    base = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(12)]
    near = lambda: [c + rng.gauss(0, scale / 3) for c in rng.choice(base)]
    rows = [(i, near(), rng.randint(0, 3)) for i in range(n)]
    rows += [(50, rows[50][1], rows[50][2]), (51, rows[50][1], 1), (52, rows[50][1], 2), (100, rows[100][1], rows[100][2])]  # repeated rows and equal vectors
    rows += [(None, near(), 0), (None, rows[50][1], 1), (150, None, 1), (200, near(), None), (250, [math.nan] * dims, 1), (300, [math.inf] * dims, 2), (351, [None] * dims, 2), (400, [], 1), (7, near()[:2], 2)]
    return rows


@pytest.mark.parametrize("dims, scale", [(5, 1.0), (17, 0.2), (3, 1e6), (4, 1e30)])
def test_hard_negatives(spark, dims, scale, monkeypatch):
    rows = vectors(420, dims, scale, random.Random(dims))
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * dims * 5)  # several blocks of anchors
    monkeypatch.setattr(hard_negatives, "BLOCKS_PER_SLOT", 1)
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in hard_negatives.hard_negatives(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows))) and (got or scale > 1e20)


def test_one_label_and_no_rows(spark):
    df = spark.createDataFrame([(i * 50, [1.0, 2.0], 3) for i in range(4)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(df.filter("vec_id % 7 > 0")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("false")).count() == 0


@pytest.mark.parametrize("scale", [2, 200, 50_000, 2**33, 2**62])
def test_packed_products_are_exact(scale):
    rng = np.random.RandomState(3)
    a, b = rng.randint(-scale, scale, (7, 9)), rng.randint(-scale, scale, (20, 9))
    want = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
    packed = hard_negatives.Packed(a, b)
    assert packed.scores(slice(0, 7)).tolist() == want and (packed.fields >= 2) == (scale <= 200)
