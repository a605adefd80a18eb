"""Exact token counts with a tokenizer library, huge documents by overlap resynchronisation."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import spread, text_or_empty

#: Texts of more characters than HUGE are encoded in overlapping chunks.
HUGE, CHUNK, OVERLAP, MEMO = 1 << 15, 1 << 14, 256, 1_000_000

Spans = list[tuple[int, int]]


@functools.cache
def span_encoder(path: str) -> tuple[Callable[[list[str]], list[Spans]], Callable[[list[str]], list[int]], bool, re.Pattern | None]:
    """Batch encoders of the library for this file: character spans of tokens, and token counts.

    The third item says whether a space between two other characters always
    parts two tokens (byte-level pre-tokens, and no added token that has or
    takes in white space); the fourth finds added tokens.
    """
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        byte_level = '"ByteLevel"' in (tok.pre_tokenizer.__getstate__().decode() if tok.pre_tokenizer else "") and tok.normalizer is None
        added = [t for t in tok.get_added_tokens_decoder().values() if t.content]
        plain = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        return (
            lambda ts: [e.offsets for e in tok.encode_batch(ts, add_special_tokens=False)],
            lambda ts: [len(e) for e in tok.encode_batch_fast(ts, add_special_tokens=False)],
            byte_level and plain,
            re.compile("|".join(re.escape(t.content) for t in added)) if added else None,
        )
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return (
        lambda ts: [[(p.begin, p.end) for p in x.pieces] for x in sp.encode(ts, out_type="immutable_proto", num_threads=1)],
        lambda ts: [len(x) for x in sp.encode(ts, num_threads=1)],
        False,
        None,
    )


BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def stable_starts(text: str, lo: int, hi: int) -> set[int]:
    """Places in text[lo:hi] where a space between two other characters starts a new pre-token, whatever surrounds them."""
    return {m.start() for m in BETWEEN.finditer(text, max(lo, 1), hi)}


def count_overlapping(text: str, spans: Callable[[list[str]], list[Spans]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text, from chunks that overlap.

    Two neighbouring chunks are spliced at a place in their overlap where both
    encodings have a token boundary and that is stable whatever surrounds it.
    Where the overlap has no such place it is doubled, up to the whole text.
    """
    total, start = 0, 0
    while start < len(text):
        wide = overlap
        while True:
            end = start + chunk + wide
            if end >= len(text):
                return total + len(spans([text[start:]])[0])
            lo = end - wide
            if places := stable_starts(text, lo, end - 1):
                here, after = spans([text[start:end], text[lo - 1 : end + wide]])
                mine = {a + start: i for i, (a, _) in enumerate(here) if a + start >= lo}
                common = places & mine.keys() & {a + lo - 1 for a, _ in after}
                if common:
                    at = max(common)
                    total += mine[at]
                    start = at
                    break
            wide *= 2
    return total


class Counter:
    """Token counts of texts; short ones by their parts between stable starts, each part encoded once by the library."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, memo: int = MEMO):
        self.spans, self.counts, self.parted, self.added = span_encoder(path)
        self.huge, self.chunk, self.overlap, self.cap = huge, chunk, overlap, memo
        self.memo: dict[str, int] = {}
        self.crowded = re.compile(r"\s (?:\s|\Z)")

    def learn(self, texts: list[list[str]]) -> None:
        """Put the words that are new into the memo: the library encodes them as one text, and offsets tell them apart."""
        if len(self.memo) > self.cap:
            self.memo.clear()
        new = list(set().union(*texts) - self.memo.keys())
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace() and not (self.added and self.added.search(w))]
        odd = list(set(new) - set(plain))
        for k in range(0, len(plain), 1000):
            words = plain[k : k + 1000]
            starts, at = [], 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
            per, j = dict.fromkeys(starts, 0), -1
            for a, _ in self.spans([" " + " ".join(words)])[0]:
                if j + 1 < len(starts) and a >= starts[j + 1]:
                    j += 1
                per[starts[j]] += 1
            self.memo.update(zip(words, per.values()))
        self.memo.update(zip(odd, self.counts([" " + w for w in odd])))

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, parted = [], []
        for i, t in enumerate(texts):
            if self.parted and len(t) > self.huge:
                out[i] = count_overlapping(t, self.spans, self.chunk, self.overlap)
            elif self.parted and not self.crowded.search(t):
                parted.append((i, t.split(" ")))
            else:
                whole.append(i)
        for i, n in zip(whole, self.counts([texts[i] for i in whole])):
            out[i] = n
        for k in range(0, len(parted), 200):
            some = parted[k : k + 200]
            self.learn([ws[1:] for _, ws in some])
            get = self.memo.__getitem__
            for (i, ws), n in zip(some, self.counts([ws[0] for _, ws in some])):
                out[i] = n + sum(map(get, ws[1:]))
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One a worker process, so that its memo serves all tasks that the worker runs."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the library for the vocabulary file counts.

    A null text counts as empty: no bytes, no tokens. Repeated rows give
    repeated results, a null key stays null, empty input gives no rows.
    Map-only. Overlapping chunks need a byte-level vocabulary, whose stable
    boundaries are known; others are encoded whole.
    """

    def run(batches):
        count = counter(path).count
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n = pa.array(count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    t = text_or_empty(text)
    rows = spread(docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes")))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
