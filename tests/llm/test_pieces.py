"""Piece encoding by backtracking against the sentencepiece library and against the merges themselves."""

import hashlib
import random

import pytest

from stridelake.llm import piece_bpe
from stridelake.llm.queries import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def strings():
    rng, model = random.Random(5), piece_bpe.encoder(PATH).model
    some = [*"abcdefgh etaoin  \n\t.,0123456789ABC▁éüß漢字の한국ـ　​ﬁＡ😀<>'\"\x00\x01", "the ", "tion", "▁▁", "    ", "<s>", "</s>", "<0x41>", "<unk>"]
    yield from ["", " ", "  ", "a", "▁", " ▁ ", "a" * 70_000, " " * 70_000, " " * 65_536 + "a", "x y" * 30_000, "漢字" * 40_000, "\n" * 66_000, " a" * 70_000, "qwertyuiop" * 9_000, "é́", "\U0001F600" * 40]
    for _ in range(2_000):
        yield "".join(rng.choice(some) for _ in range(rng.randint(0, rng.choice([5, 30, 200]))))
    for _ in range(1_000):  # glued pieces
        yield "".join(model.piece[rng.randint(259, 31_999)] for _ in range(rng.randint(1, 12))).replace("▁", rng.choice(["", " ", "▁"]))
    for _ in range(500):
        yield "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(0, 60)))


def test_ids_and_decoding_are_the_librarys(library):
    memo = piece_bpe.Encoder(piece_bpe.Model(PATH), cap=500)
    for t in strings():
        parts = list(memo.round_trip(t))
        want = library.encode(t, add_eos=True)
        assert [int(i) for ids, _ in parts for i in ids.split()] == want
        assert b"".join(d for _, d in parts).decode() == library.decode(want)
        decoder = piece_bpe.Decoder(memo.model)
        assert "".join([*(decoder.feed([i]) for i in want), decoder.finish()]) == library.decode(want)


def test_decoder_on_any_ids(library):
    rng, model = random.Random(6), piece_bpe.encoder(PATH).model
    for _ in range(2_000):  # bytes that are no UTF-8 apart, control ids and spaces at the start
        ids = [rng.choice([rng.randint(3, 130), rng.randint(259, 400), 1, 2, 28705]) for _ in range(rng.randint(0, 8))]
        decoder = piece_bpe.Decoder(model)
        assert decoder.feed(ids) + decoder.finish() == library.decode(ids)


def test_backtracking_equals_merging():
    """Small vocabularies with many ties and dead ends."""
    rng = random.Random(7)
    for _ in range(60):
        model = piece_bpe.Model.__new__(piece_bpe.Model)
        model.score, model.agree = {c: 0.0 for c in "abc"}, {}
        for k in range(rng.randint(2, 25)):
            model.score.setdefault("".join(rng.choice("abc") for _ in range(rng.randint(2, 5))), -float(rng.choice([k, k // 3])))
        model.ids = {p: i for i, p in enumerate(model.score)}
        model.longest = piece_bpe.ahocorasick.Automaton()
        for p in model.ids:
            model.longest.add_word(p[::-1], len(p))
        model.longest.make_automaton()
        for _ in range(40):
            text = "".join(rng.choice("aaabbcd") for _ in range(rng.randint(0, 60)))
            assert model.pieces(text) == model.merge(text)


def test_encode_documents(spark, library):
    texts = [None, "", "one two", "one two", " lead", "漢字 \U0001F600", "w " * 50_000]
    df = spark.createDataFrame([(None if i == 2 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append(str((None if i == 2 else i, len(ids), ids, sha(" ".join(map(str, ids))), sha(library.decode(ids)))))
    assert sorted(str(tuple(r)) for r in piece_bpe.encode_documents(df, PATH).collect()) == sorted(want)
    assert piece_bpe.encode_documents(df.filter("false"), PATH, with_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert piece_bpe.encode_documents(df.filter("false"), PATH).count() == 0
