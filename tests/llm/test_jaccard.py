"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import os
import random

import pytest

import corpus_pipeline
from stridelake.llm import jaccard, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = simhash.WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_force(rows):
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(str((k, least.get(root(i)))) for i, (k, _) in enumerate(rows))


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randint(0, 10**9)}"
    return " ".join(w)


def fixture():
    rng = random.Random(5)
    make = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    base = [make(rng.randint(60, 300)) for _ in range(40)]
    out = list(base)
    for b in base[:25]:
        out += [edited(rng, b, max(1, len(b.split()) // 70)), edited(rng, b, len(b.split()) // 20)]
    crowd = make(120)
    out += [edited(rng, crowd, 2) for _ in range(60)]
    out += [None, "", " \n", "one two", "ONE two", "a b c d e", base[0].upper()]
    return [(i * 2, t) for i, t in enumerate(out)] + [(None, base[1]), (4, base[2])]


def test_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 16)
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_force(rows)
    assert sorted(str(tuple(r)) for r in jaccard.near_duplicates(docs).drop("kept").collect()) == want
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark):
    """Copies at similarity 0.8 and above, most of them over three SimHash bits away."""
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, edited(rng, b, 3)) for i, b in enumerate(base)]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(str(tuple(r)) for r in jaccard.near_duplicates(docs).drop("kept").collect()) == brute_force(rows)


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_components_in_rounds(spark, monkeypatch, most):
    """Chains, stars, loops and repeats, with tasks that hold few edges at a time."""
    from stridelake.llm import components
    from stridelake.llm.common import Scratch

    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(most)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5000, 5000), (7, 7), (None, 3), (61, 2000), (2000, 1999)]
    edges += [(rng.randint(10_000, 10_060), rng.randint(10_000, 10_060)) for _ in range(40)] + [(3, 4)] * 5
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), scratch).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
