"""Text operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import bpe, digest, exact_dedup, license_scan, packing, quality, simhash, token_counts
from stridelake.llm.common import TASK_BYTES, shuffle_tasks
from stridelake.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, part int, words int"


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.randint(3, 80)) for _ in range(40)]
    near = [b.replace(b.split()[0], "zz", 1) for b in base[:10]]
    same = [b.upper() for b in base[5:12]]
    long = make(9000)
    odd = [None, "", " ", "\n\n", "a", "é" * 700, "漢字" * 300, "x" * 40_000, long, long + " end", "tab\tand  two spaces", "<|endoftext|> in <|endoftext|>", "ÀÉ", "àé", "\U0001F600 don't they'll", "0123456789" * 50]
    return base + near + same + odd + base[:3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", f"s{i % 2}", 0, 1.0, "f", 1, 2) for i, t in enumerate(texts())] + [(None, "no key", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates(docs, empty):
    want, groups = {}, {}
    for i, t in rows_of(docs):
        groups.setdefault(t.translate(LOWER), []).append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert r["doc_id"] in ids and r["keep_id"] == keep and r["group_size"] == len(ids) and r["kept"] == (r["doc_id"] == keep)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_splits_late(spark):
    a = "p" * 40_000
    rows = [(1, a), (2, a), (3, a + "q"), (4, a + "q"), (5, a[:32]), (6, a[:32]), (7, a[:33]), (8, "P" * 32)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 4, 4: 4, 5: 8, 6: 8, 7: 7, 8: 8}


def test_tasks_follow_the_bytes(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with shuffle_tasks(spark, 100 * TASK_BYTES + 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "101"
    with shuffle_tasks(spark, 10):
        assert spark.conf.get("spark.sql.shuffle.partitions") == was
    assert spark.conf.get("spark.sql.shuffle.partitions") == was


def plain_simhash(text):
    import xxhash

    w = simhash.WORD.findall(text.translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(fps))]


def test_near_duplicates(docs, empty):
    rows = rows_of(docs)
    fps = [plain_simhash(t) for _, t in rows]
    want = sorted(map(str, zip([i for i, _ in rows], (f"{f:016x}" for f in fps), components(fps, [i for i, _ in rows], 3))))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 3, 5])
def test_links_lose_nothing(spark, radius):
    """Random fingerprints with planted neighbours, chains and a dense group, in several blocks a cell."""
    from stridelake.llm.common import Scratch
    from stridelake.llm.components import connected_components

    rng = np.random.RandomState(radius)
    fps = set(rng.randint(-(2**63), 2**63 - 1, 300, dtype=np.int64).tolist())
    for f in list(fps)[:40]:
        for _ in range(5):
            f ^= int(np.int64(np.uint64(1) << np.uint64(rng.randint(64))))
            fps.add(f)
    fps |= {0, -1, 1, 3, 7, 1 << 40} | {int(1 << i | 1 << j) for i in range(12) for j in range(i)}
    fps = sorted(fps)
    old, simhash.TILE_ROWS = simhash.TILE_ROWS, 7
    try:
        scratch = Scratch(spark, "test")
        links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch, radius)
        roots = {r["node"]: r["root"] for r in connected_components(scratch.save(links, "links"), scratch).collect()}
    finally:
        simhash.TILE_ROWS = old
    want = components([f % 2**64 for f in fps], list(range(len(fps))), radius)
    seen = {}
    for f, w in zip(fps, want):
        assert seen.setdefault(w, roots.get(f, f)) == roots.get(f, f)
    assert len(set(seen.values())) == len(set(want))


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    got = bpe.encode_documents(docs, vocabulary_path()).collect()
    want = []
    for i, t in rows_of(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.encode_documents(empty, vocabulary_path()).count() == 0


def test_bpe_streams_in_any_pieces():
    from tokenizers import Tokenizer

    tok, vocab = Tokenizer.from_file(vocabulary_path()), bpe.vocabulary(vocabulary_path())
    rng = random.Random(5)
    alphabet = [*"abcdetn    \n\n\t.,!'é漢1²½<|>_-\x1c\x85\xa0 　﻿\x00\U0001F600", "<|endoftext|>", "'re", " the", "ing", "\r\n"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    odd += ["".join(rng.choice("abcdefghinotrs") for _ in range(9000)), " " * 9000 + "x", "-" * 9000 + "<|endoftext|>" + "=" * 9000, "é" * 7000 + "<|endo"]
    assert 0 < vocab.lookahead < 1000
    for s in odd:
        want = bpe.pack(tok.encode(s, add_special_tokens=False).ids)
        for block in (7, 64, 5000):
            assert b"".join(bpe.Encoder(vocab, block, memo=50).encode(s)) == want, (block, s[:80])
        decoder = bpe.Decoder(vocab)
        assert "".join(decoder.feed(want[i : i + 20]) for i in range(0, len(want), 20)) + decoder.finish() == s


def test_ids_come_out_while_the_text_goes_on():
    """Texts of ten million characters, with spaces and without: no part is much larger than what was fed, and little is held."""
    import tracemalloc

    vocab = bpe.vocabulary(vocabulary_path())
    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghinotrs") for _ in range(5000))
    for unit in ("some words of a text, and more. ", word, "é" * 50, "=-" * 50, "\n\n\n"):
        fed, held, out = 0, [0], 0
        enc = bpe.Encoder(vocab, memo=1000)

        def pieces(unit=unit):
            nonlocal fed
            piece = (unit * (bpe.BLOCK // len(unit) + 1))[: bpe.BLOCK]
            for _ in range(60):
                fed += len(piece.encode())
                yield piece

        tracemalloc.start()
        for packed in enc.encode_stream(pieces()):
            out += sum(len(vocab.bytes_of[i]) for i in np.frombuffer(packed, "<u4").tolist())
            held.append(fed - out)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out == fed and max(held) < 4 * bpe.BLOCK and peak < 12 << 20, (unit[:10], max(held), peak)


def test_lookahead_is_used_on_the_table(spark):
    """Pre-tokens longer than the window come out by the lookahead, as the library has them."""
    from tokenizers import Tokenizer

    tok, vocab = Tokenizer.from_file(vocabulary_path()), bpe.vocabulary(vocabulary_path())
    rng = random.Random(10)
    for n in (300, 1000, 20_000):
        for alphabet in ("ab", "etaoinshr", "=", "漢字仮名", "0123456789"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            parts = list(vocab.pre_token(t.encode(), 2 * vocab.lookahead))
            assert len(parts) > 1 and [i for p in parts for i in p] == tok.encode(t, add_special_tokens=False).ids


def test_decoder_replaces_broken_sequences():
    vocab = bpe.vocabulary(vocabulary_path())
    decoder = bpe.Decoder(vocab)
    assert decoder.feed(bpe.pack([vocab.byte_ids[0xE6]])) + decoder.feed(bpe.pack([vocab.byte_ids[0x61]])) + decoder.finish() == "\ufffda"
    assert decoder.feed(bpe.pack([vocab.byte_ids[0xE6]])) + decoder.finish() == "\ufffd"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, empty, name):
    path = vocabulary_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation(), tok.no_padding()
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path).collect())
    assert got == sorted((str(i), len(t.encode()), n := count(t), n > 512) for i, t in rows_of(docs))
    assert token_counts.token_counts(empty, path).count() == 0


def test_overlaps_widen_until_they_align():
    spans, counts, *_ = token_counts.span_encoder(vocabulary_path())
    rng = random.Random(2)
    for _ in range(60):
        t = "".join(rng.choice([*"abc de\n  .1é", "<|endoftext|>", "x" * 50]) for _ in range(rng.randint(1, 300)))
        assert token_counts.count_overlapping(t, spans, 20, 4) == counts([t])[0]


def edited_rows(rows):
    """Brute force over (key, text) rows: by key, then by hash of the text, then by text."""
    import xxhash

    hashed = [(i is not None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42), t, i) for i, t in rows]
    rows = [(i, t) for *_, t, i in sorted((a, b, h - 2**64 if h >= 2**63 else h, t, i) for a, b, h, t, i in hashed)]
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 2
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = (digest.digest(x.encode()) for x in (t, e, nxt))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    return sorted(want)


@pytest.mark.parametrize("range_bytes", [1 << 30, 5000, 300])
def test_digests(docs, empty, range_bytes):
    got = digest.edited_digests(docs, range_bytes=range_bytes).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == edited_rows(rows_of(docs))
    assert digest.edited_digests(empty).count() == 0
    assert digest.edited_digests(docs.filter("doc_id = 0")).first()["near_next"] == 1.0


def test_digests_of_a_hot_key(spark):
    """A key with most rows, and copies of one row under one key, are cut into many ranges."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(40))) for i in range(100)]
    rows += [(50, "".join(rng.choice("abcde ") for _ in range(40))) for _ in range(300)] + [(70, "one and the same row")] * 300 + [(None, "none")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = digest.edited_digests(docs, range_bytes=600)
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert max(sizes) < 100 and len(sizes) > 20
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == edited_rows(rows)


def test_digests_keep_their_order_in_a_hot_slot(spark):
    """Texts whose hashes share their first bits, many rows each under one key: only copies of one text are dealt."""
    import xxhash

    by_slot = {}
    for i in range(40_000):
        by_slot.setdefault(xxhash.xxh64_intdigest(f"text number {i} of many".encode(), 42) >> 52, []).append(f"text number {i} of many")
    crowd = next(v for v in by_slot.values() if len(v) >= 8)[:3]
    rows = [(7, t) for t in crowd for _ in range(12)] + [(3, "before"), (9, "after it all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = digest.edited_digests(docs, range_bytes=150)
    by_hash = sorted(rows, key=lambda r: (r[0], (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2**63) % 2**64, r[1]))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == edited_rows(by_hash)
    assert sum(n > 0 for n in got.rdd.glom().map(len).collect()) > 3


def test_digest_is_bounded_and_blockwise():
    rng = np.random.RandomState(0)
    a, b = rng.bytes(3000), rng.bytes(50)
    assert 0 <= digest.likeness(digest.digest(a), digest.digest(b)) <= 1 and digest.difference(digest.digest(a), digest.digest(a)) == 0
    assert digest.likeness(digest.digest(b""), digest.digest(b"\xff" * 9)) >= 0
    old, digest.STEP = digest.STEP, 100
    try:
        small = digest.bucket_counts(a)
    finally:
        digest.STEP = old
    assert (small == digest.bucket_counts(a)).all() and small.sum() == 6 * (3000 - 4)


@pytest.mark.parametrize("length", [None, "n_chars", "regexp_count(text, 'a')"])
def test_packing(docs, empty, length):
    length = length and F.expr(length)
    got = packing.pack_batches(docs, length=length, buckets=4, budget=300).collect()
    lengths = [r[0] or 0 for r in docs.select(F.coalesce(F.octet_length("text"), F.lit(0)) if length is None else length).collect()]
    assert sorted(r["n_tokens"] for r in got) == sorted(lengths)
    batches, bounds = {}, sorted({r["bucket_tokens"] for r in got})
    for r in got:
        assert r["n_tokens"] + r["padding"] == r["bucket_tokens"] == min(b for b in bounds if b >= r["n_tokens"])
        batches.setdefault(r["batch"], []).append((r["slot"], r["bucket_tokens"]))
    for slots in batches.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots))) and len({b for _, b in slots}) == 1
        assert len(slots) == 1 or len(slots) * slots[0][1] <= 300
    for b in bounds:
        full = sorted((len(s) for s in batches.values() if s[0][1] == b), reverse=True)
        assert all(n == max(1, 300 // max(b, 1)) for n in full[:-1])
    assert sorted(batches) == list(range(len(batches)))
    assert sum(r["padding"] for r in got) == least_padding(lengths, 4)
    assert packing.pack_batches(empty).count() == 0


def least_padding(lengths, buckets):
    """By the plain recurrence over all splits."""
    sizes = sorted(set(lengths))
    count = [lengths.count(s) for s in sizes]
    cost = lambda i, j: sum(c * (sizes[j - 1] - s) for s, c in zip(sizes[i:j], count[i:j]))
    best = [0] + [cost(0, j) for j in range(1, len(sizes) + 1)]
    for _ in range(buckets - 1):
        best = [min(best[i] + cost(i, j) for i in range(j + 1)) if j else 0 for j in range(len(sizes) + 1)]
    return best[-1]


def test_long_lengths_have_exact_boundaries(spark):
    rows = [(i, "x" * n) for i, n in enumerate([5001, 5001, 5001, 9001])]
    got = packing.pack_batches(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["n_tokens"], r["bucket_tokens"], r["padding"]) for r in got.collect()} == {(5001, 5001, 0), (9001, 9001, 0)}


def test_boundaries_are_optimal():
    rng = np.random.RandomState(4)
    for _ in range(60):
        top = int(rng.choice([50, 20_000, 10**7]))
        lengths = rng.randint(0, top, rng.randint(1, 40)).tolist() * 2
        k = int(rng.randint(1, 7))
        sizes, counts = np.unique(lengths, return_counts=True)
        bounds = packing.optimal_boundaries(sizes.astype(np.int64), counts.astype(np.int64), k)
        assert len(bounds) <= k and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == least_padding(lengths, k)


def test_licenses(spark, empty):
    mit = license_scan.TEMPLATES[2][1]
    rows = [
        (1, "prose\nReleased under the MIT license\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, mit.upper().replace(". ", ".\n")), (4, None), (5, ""),
        (6, "the license of the software is not stated anywhere in this text"), (7, "Released under the MIT License.\nReleased under the MIT License."), (7, "Released under the MIT License.\nReleased under the MIT License."), (8, "x " * 50_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("words", F.lit(1))

    def dice(a, b):
        from collections import Counter

        x, y = (Counter(zip(w, w[1:])) for w in (a, b))
        n = sum(x.values()) + sum(y.values())
        return 2 * sum((x & y).values()) / n if n else 0

    want = set()
    for i, t in rows:
        lines = (t or "").split("\n")
        for no, unit in [*enumerate(lines, 1), *([(0, t)] if len(lines) > 1 else [])]:
            best = {}
            for k, (name, template) in enumerate(license_scan.TEMPLATES):
                d = dice(license_scan.words_of(unit), license_scan.words_of(template))
                if d >= 0.8 and d > best.get(name, (0, 0))[0]:
                    best[name] = (d, k)
            want |= {(i, no, name, k, round(d, 6)) for name, (d, k) in best.items()}
    got = [(r["doc_id"], r["line_no"], r["license"], r["template"], r["dice"]) for r in license_scan.scan_units(license_scan.once(docs, "doc_id", "text")).collect()]
    assert set(got) == want and len(want) >= 5
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_is_native(spark, docs):
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    good = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [rng.choice(good) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w) + "." if not bad else rng.choice([" | ".join(w), "!! ".join(x.upper() for x in w), " ".join(w[:2] * 30)]), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.drop("quality"), df.drop("text")


def test_quality_on_held_out_rows(graded):
    docs, labels = graded
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in got if got[i]["held_out"]]
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["held_out"] for i in got)
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_held_out_labels_are_never_learned(graded):
    docs, labels = graded
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, flipped))
    assert a.bias == b.bias and (a.factors == b.factors).all()


def test_quality_without_labels_or_rows(docs, empty, graded):
    labels = graded[1]
    got = quality.score_quality(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0
    model = quality.train(*graded)
    named = quality.score(docs, model)
    assert "score_in" in named.columns and named.count() == docs.count()


def test_repeated_keys_do_not_widen_the_sample(graded):
    docs, labels = graded
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    model = quality.train(twice, labels, rows=50)
    assert len(model.linear) == quality.SIZE
    got = quality.score_quality(twice, labels).collect()
    assert len(got) == twice.count()


def test_score_is_what_the_features_give(graded):
    """Scores of the query, by the plain sum over pairs."""
    docs, labels = graded
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    for r in docs.limit(20).collect():
        idx, val = quality.Features().of(r["text"])
        z = model.bias + model.linear[idx] @ val
        z += sum(model.factors[idx[i]] @ model.factors[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4


def test_pair_sum_identity():
    rng = np.random.RandomState(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    idx, val = np.array([1, 5, 9, 4100]), rng.rand(4)
    pairs = sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert np.isclose(fm.raw(idx, val, np.array([0]))[0][0], 0.3 + fm.linear[idx] @ val + pairs)
