"""The pipeline against a brute-force version, and the contract of the entry module."""

import os
import sys

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from stridelake.llm import quality
from stridelake.llm.common import Scratch
from stridelake.llm.queries import ORACLE_SQL, QUERIES, vocabulary_path

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard import plain_set, similar  # noqa: E402
from test_texts import least_padding  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_rows(rows, good):
    """Brute force over (doc_id, text) rows: exact copies, then components of five-word shingles at Jaccard >= 0.8."""
    rank = lambda i: (i is not None, i or 0)
    best = {}
    for i, t in rows:
        if good(i, t) and (t.translate(LOWER) not in best or rank(i) > rank(best[t.translate(LOWER)][0])):
            best[t.translate(LOWER)] = (i, t)
    left = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [plain_set(t) for _, t in left]
    group = list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for a in range(len(left)):
            for b in range(a):
                if group[a] != group[b] and similar(sets[a], sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    first = {}
    for k, g in enumerate(group):
        first.setdefault(g, left[k])
    return list(first.values())


def test_pipeline_is_what_brute_force_gives(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in kept_rows(rows, lambda i, t: i in good)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
    assert sum(r["padding"] for r in got) == least_padding(list(want.values()), 16)


ODD = [
    (1, "alpha beta gamma"), (1, "one two three four"), (2, "ALPHA beta gamma"), (5, "the same row twice"), (5, "the same row twice"),
    (None, "a copy without a key"), (None, "a copy without a key"), (None, None), (7, ""), (8, " ".join(f"w{i}" for i in range(60))), (8, " ".join(f"w{i}" for i in range(61))),
]


@pytest.mark.parametrize("stored", [True, False])
def test_dedup_stages_drop_rows_not_keys(spark, stored):
    """Repeated keys, null keys and texts, clashing columns: one row of a group stays, and no unique text goes."""
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in ODD], "doc_id long, text string, _gone int, _row int, kept int").repartition(3)
    if stored:
        docs = Scratch(spark, "test").save(docs, "docs")
    for stage, same in ((corpus_pipeline.exact_dedup_stage, lambda t: (t or "").translate(LOWER)), (corpus_pipeline.near_dedup_stage, lambda t: (t or "")[:14].translate(LOWER))):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted(same(r["text"]) for r in out.collect())
        assert got == sorted({same(t) for _, t in ODD})
    kept = {r["text"]: r["doc_id"] for r in corpus_pipeline.exact_dedup_stage(spark, docs, SF).collect()}
    assert kept["ALPHA beta gamma"] == 2 and kept["one two three four"] == 1 and kept["a copy without a key"] is None and kept[""] == 7


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_quality_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_quality", F.lit("mine")).withColumn("score", F.lit(7))
    out = corpus_pipeline.quality_filter(spark, docs, SF)
    assert out.columns == docs.columns and {r["_quality"] for r in out.select("_quality").distinct().collect()} == {"mine"}


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import sys

    import duckdb

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from compare import same, views

    same(QUERIES[name](spark, SF), views(duckdb.connect(), SF), ORACLE_SQL[name])
