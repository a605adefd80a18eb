"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

The encoder takes text in pieces of any size and emits token ids as soon as no
continuation can change them. Two kinds of boundary are stable:

* between pre-tokens: a space between two non-space characters always starts
  a new pre-token, whatever follows;
* inside a pre-token: a token that ends further from the end of the known
  bytes than the merge list's sufficient lookahead.

Every text goes through the transducer in blocks: ids are hashed and decoded as
they come out, so memory is bounded by the block size, the lookahead and the
memo's cap, whatever the text. The memo only holds what the transducer gave for
a pre-token before.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import spread, text_or_empty

# The pre-token pattern of the byte-level vocabulary. \s is spelt
# out as the characters with the White_Space property.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
RUNS = [r"\p{L}+", r"\p{N}+", rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"[{SPACE}]+"]

BLOCK, MEMO = 1 << 14, 600_000


def byte_alphabet() -> dict[str, int]:
    """The vocabulary files' character for each byte: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must be known after a token's end before the token is certain.

    What lies beyond the known bytes can only change whether some merge at
    their end applies. That disturbance moves left only by a later merge whose
    right part starts where the disturbed merge did; the new merge may in turn
    be disturbed, but ranks only rise along such a chain. The bound is the
    longest way, in bytes, that any chain can reach; it takes one pass over
    the merges from the last to the first.
    """
    as_right: dict[bytes, int] = {}
    as_left: dict[bytes, int] = {}
    most = 0
    for left, right in reversed(merges):
        both = left + right
        reach = max(as_right.get(both, 0), as_right.get(left, 0), as_left.get(both, 0), as_left.get(left, 0))
        most = max(most, len(both) + reach)
        as_right[right] = max(as_right.get(right, 0), len(left) + reach)
        as_left[left] = max(as_left.get(left, 0), reach)
    return most


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.byte_ids = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.ranks = {vocab[a] << 32 | vocab[b]: (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.id_of, self.widest, self.agree = vocab, min(64, max(map(len, vocab))), {}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.specials.items()}
        self.lookahead = sufficient_lookahead(pairs)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.longest_special = max(map(len, self.specials), default=0)
        self.pattern = regex.compile(PATTERN)
        self.runs = [regex.compile(p) for p in RUNS]

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token: the lowest-ranked merge first, leftmost of equals."""
        ids, ranks = [self.byte_ids[b] for b in data], self.ranks
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def tokens(self, data: bytes) -> list[int]:
        """Tokens of one pre-token, as merge() gives them.

        A sequence of tokens is the encoding of its bytes exactly if each two
        neighbours are the encoding of theirs. So any walk whose neighbours
        all agree is the answer. Longer tokens are tried first; an end from
        which no walk goes on is not tried again, since the encoding up to it,
        and with it the last token, is the same each time.
        """
        n, ids, agree, widest = len(data), self.id_of, self.agree, self.widest
        if n > 64:
            return self.merge(data)
        out, way, dead, at, last, end = [], [], set(), 0, -1, min(n, widest)
        while at < n:
            while end > at:
                if (t := ids.get(data[at:end])) is not None and end not in dead:
                    if (ok := agree.get(last << 32 | t)) is None:
                        ok = self.agrees(last, t)
                    if ok:
                        break
                end -= 1
            if end > at:
                way.append((at, last))
                out.append(t)
                at, last, end = end, t, min(n, end + widest)
            elif out:
                dead.add(at)
                end = at - 1
                out.pop()
                at, last = way.pop()
            else:
                return self.merge(data)
        return out

    def stable(self, known: bytes) -> tuple[list[int], int]:
        """Tokens at the start of a pre-token that no continuation of its known bytes can change, and their bytes."""
        done, size, certain = [], 0, len(known) - self.lookahead
        for i in self.merge(known):
            if size + len(self.bytes_of[i]) > certain:
                break
            done.append(i)
            size += len(self.bytes_of[i])
        return done, size

    def pre_token(self, data: bytes, window: int) -> Iterator[list[int]]:
        """Tokens of one pre-token; a long one passes through a window, from whose start stable tokens are emitted."""
        at = 0
        while len(data) - at > window:
            done, size = self.stable(data[at : at + window])
            yield done
            at += size
        yield self.tokens(data[at:])

    def agrees(self, last: int, t: int) -> bool:
        """Whether two tokens (one, if last is negative) are the encoding of their bytes."""
        if len(self.agree) >= MEMO:
            self.agree.clear()
        pair = [t] if last < 0 else [last, t]
        ok = self.agree[last << 32 | t] = self.merge(b"".join(map(self.bytes_of.__getitem__, pair))) == pair
        return ok

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n."""
        ranks, n = self.ranks, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = ranks[a << 32 | b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process, so that its memo serves all tasks that the worker runs."""
    return Encoder(vocabulary(path))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Memo of the packed ids of space-led words; cleared when it reaches its cap."""

    def __init__(self, encode, cap: int):
        super().__init__()
        self.encode, self.cap = encode, cap

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.cap:
            self.clear()
        out = self.encode(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Encoder:
    """encode_stream(text pieces) yields packed ids (little-endian 32-bit) as they become stable.

    `long` is the length, in characters or bytes, from which a pre-token is
    not awaited whole: its stable start is emitted by the lookahead.
    """

    def __init__(self, vocab: Vocabulary, block: int = BLOCK, memo: int = MEMO, long: int | None = None):
        self.vocab, self.block, self.long = vocab, block, max(long or 0, 2 * vocab.lookahead)
        self.pre = _Words(lambda w: b"".join(map(pack, self.vocab.pre_token(w.encode("utf-8"), self.long))), memo)
        self.words = _Words(self.word, memo)
        self.crowded = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")

    def word(self, w: str) -> bytes:
        """A word led by a space: letters, perhaps with one other character after them, need no pattern."""
        if w.isalpha():
            return self.pre[" " + w]
        if w[:-1].isalpha() and w[-1] in ".,;:!?":
            return self.pre[" " + w[:-1]] + self.pre[w[-1]]
        return self.complete(" " + w)

    def complete(self, text: str) -> bytes:
        """A text that starts and ends at stable boundaries."""
        vocab, out, at = self.vocab, [], 0
        if not any(x in text for x in vocab.specials):
            return self.plain(text)
        for m in vocab.special.finditer(text):
            out += [self.plain(text[at : m.start()]), pack([vocab.specials[m[0]]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pre.__getitem__, self.vocab.pattern.findall(text)))

    def spaced(self, text: str) -> bytes:
        """A stable stretch, cut at its single spaces where white space is not crowded."""
        if self.crowded.search(text):
            return self.complete(text)
        first, *rest = text.split(" ")
        return b"".join([self.complete(first), *map(self.words.__getitem__, rest)])

    def cut(self, text: str) -> int:
        """The last place where a space stands between two other characters, 0 if there is none."""
        p = text.rfind(" ", 1, len(text) - 1)
        while p > 0 and (text[p - 1].isspace() or text[p + 1].isspace()):
            p = text.rfind(" ", 1, p)
        return max(p, 0)

    def encode_stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        tail, run, known = "", None, b""  # known: bytes of a long pre-token's stable end; run: what continues it
        for piece in pieces:
            tail += piece
            if run is None and (p := self.cut(tail)):
                yield self.spaced(tail[:p])
                tail = tail[p:]
            if run is not None or len(tail) > self.long:
                out, tail, run, known = self.unspaced(tail, run, known, False)
                yield out
        if run is not None:
            out, tail, run, known = self.unspaced(tail, run, known, True)
            yield out
        yield self.spaced(tail)

    def unspaced(self, text: str, run, known: bytes, last: bool):
        """Emit what is stable of a stretch without a cut: whole pre-tokens, and the start of a long one."""
        vocab, out = self.vocab, []
        if vocab.special and (m := vocab.special.search(text)):
            done, _, _, _ = self.unspaced(text[: m.start()], run, known, True) if run is not None else (self.plain(text[: m.start()]), "", None, b"")
            return done + pack([vocab.specials[m[0]]]), text[m.end() :], None, b""
        held = 0 if last else max(3, vocab.longest_special)  # a special token or a contraction may straddle the end
        at, limit = 0, len(text) - held
        if run is not None:
            m = run.match(text, 0, max(limit, 0))
            more = m.end() if m else 0
            if run is vocab.runs[3] and more and more < len(text) and not text[more].isspace():
                more -= 1  # the last white space before a word is not part of the run
            known += text[:more].encode("utf-8")
            at = more
            if more < limit or last:
                out.append(pack(vocab.merge(known)))
                run, known = None, b""
        if run is None:
            for m in vocab.pattern.finditer(text, at):
                if m.end() > limit - 1 and not last:
                    if limit - m.start() > self.long:
                        run = next(r for r in vocab.runs if r.match(text, m.start() + (text[m.start()] == " " and not text[m.start() + 1].isspace())))
                        stop = limit - 1
                        known, at = text[m.start() : stop].encode("utf-8"), stop
                    break
                out.append(self.pre[m[0]])
                at = m.end()
        if run is not None and len(known) > self.long:
            done, size = vocab.stable(known)
            out.append(pack(done))
            known = known[size:]
        return b"".join(out), text[at:], run, known

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text, in parts."""
        return self.encode_stream(text[i : i + self.block] for i in range(0, len(text), self.block))


class Decoder:
    """Packed ids in parts to text in parts; an unfinished UTF-8 sequence waits for the next part."""

    def __init__(self, vocab: Vocabulary):
        self.bytes_of, self.state = vocab.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def finish(self) -> str:
        """What an unfinished sequence at the end gives; the decoder then starts anew."""
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit, if asked for), ids_sha256, decoded_sha256 for every row.

    Ids are those of the tokenizers library without begin, end or added
    special tokens; special strings inside a text become their special id. A
    null text counts as empty: no tokens, the hash of no bytes. Repeated rows
    give repeated results, a null key stays null, empty input gives no rows.
    Map-only: no shuffle, one text in memory at a time.
    """

    def run(batches):
        encode, decoder = encoder(path).encode, Decoder(vocabulary(path))
        for b in batches:
            n, ids, shas, decoded = [], [], [], []
            for t in b.column(1):
                size, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for packed in encode(t.as_py()):
                    size += len(packed) // 4
                    of_ids.update(packed)
                    of_text.update(decoder.feed(packed).encode("utf-8"))
                    if with_ids:
                        kept.append(packed)
                of_text.update(decoder.finish().encode("utf-8"))
                n.append(size)
                shas.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
                ids.append(b"".join(kept))
            cols = [b.column(0), pa.array(n, pa.int64())] + [pa.array(ids, pa.binary())] * with_ids + [pa.array(shas), pa.array(decoded)]
            names = ["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))).mapInArrow(run, schema)
