"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A sequence of pieces is the encoding of a text exactly if each two neighbours
are the encoding of their own characters: a merge over a boundary that the
whole text would make, the two neighbours alone would make too. So the encoder
walks from left to right, takes the longest piece at each place (Aho-Corasick
over the reversed text finds them all in one pass), goes on to shorter ones
while neighbours do not agree, and back where none is left. An end from which
no walk goes on is marked in a bitfield and never tried again, which makes the
walk linear. Whether neighbours agree is found by merging their characters
anew, once a pair.

A merge is ruled by the score of the piece it makes, the leftmost first of
equals. Characters without a piece are never merged and become byte pieces.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import spread, text_or_empty

SPACE = "▁"
#: Characters of a block of text, words memorised a worker, and the longest word that is memorised.
BLOCK, MEMO, WORD = 1 << 16, 600_000, 64


class Model:
    """Pieces, scores and ids of a model file, and the exact encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.normalize, self.end = sp.normalize, sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {i: int(p[3:-1], 16) for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.silent, self.unknown = {i for i in range(n) if sp.is_control(i)}, sp.unk_id()
        self.text = [p.replace(SPACE, " ") for p in self.piece]
        self.plain = set(self.ids.values())  # ids that decode to their piece
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.decimal = [f" {i}".encode() for i in range(n)]
        self.longest = ahocorasick.Automaton()
        for p in self.ids:
            self.longest.add_word(p[::-1], len(p))
        self.longest.make_automaton()
        self.agree: dict[tuple[str, str], bool] = {}
        #: Whether a space after another character always starts a piece, so that words are encoded one by one.
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agrees(self, last: str, piece: str) -> bool:
        """Whether two neighbours (or one piece after nothing) are the encoding of their characters."""
        if len(self.agree) >= MEMO:
            self.agree.clear()
        ok = self.agree[last, piece] = self.merge(last + piece) == ([last, piece] if last else [piece])
        return ok

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece at the same place; a single character always counts as one."""
        for k in range(len(piece) - 1, 0, -1):
            if k == 1 or piece[:k] in self.ids:
                return piece[:k]
        return None

    def pieces(self, text: str) -> list[str]:
        """Pieces of a normalised text, by backtracking."""
        n = len(text)
        widest = [1] * n
        for end, size in self.longest.iter(text[::-1]):
            at = n - 1 - end
            if size > widest[at]:
                widest[at] = size
        failed, out, at, agree = bytearray(n // 8 + 1), [], 0, self.agree
        piece = text[: widest[0]] if n else None
        while at < n:
            last = out[-1] if out else ""
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = agree.get((last, piece))
                    if self.agrees(last, piece) if ok is None else ok:
                        break
                piece = self.shorter(piece)
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = text[at : at + widest[at]] if at < n else None
            else:  # no walk goes on from here: back to the piece that led here, which is then shortened
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text, or of a stretch of it between stable boundaries."""
        ids, out = self.ids, []
        found = self.pieces(text)
        try:
            return [ids[p] for p in found]
        except KeyError:
            pass
        for p in found:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += map(self.byte_id.__getitem__, p.encode("utf-8"))
            elif not out or out[-1] != self.unknown:  # without byte pieces a run of unknown characters is one id
                out.append(self.unknown)
        return out

    def blocks(self, text: str) -> Iterator[str]:
        """A normalised text in blocks that end at stable boundaries; one without any is one block."""
        at, n = 0, len(text)
        while self.parted and n - at > BLOCK:
            cut = text.rfind(SPACE, at + 1, at + BLOCK)
            while cut > at and text[cut - 1] == SPACE:
                cut -= 1
            if cut <= at:
                found = re.compile(f"[^{SPACE}](?={SPACE})").search(text, at)
                if not found:
                    break
                cut = found.end()
            yield text[at:cut]
            at = cut
        if at < n:
            yield text[at:]


class Decoder:
    """Ids to text, piece by piece; bytes of a character wait until it is whole, and one leading space is dropped."""

    def __init__(self, model: Model):
        self.model, self.state, self.begun = model, codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: list[int]) -> str:
        model, out = self.model, []
        if self.begun and not self.state.getstate()[0] and model.plain.issuperset(ids):
            return "".join(map(model.text.__getitem__, ids))
        for i in ids:
            if (b := model.byte.get(i)) is not None:
                out.append(self.state.decode(bytes([b])))
                self.begun = True
                continue
            out.append(self.state.decode(b"", True))
            if i in model.silent:
                continue
            piece = " ⁇ " if i == model.unknown else model.text[i]
            if not self.begun and piece.startswith(" ") and i != model.unknown:
                piece = piece[1:]
            self.begun = True
            out.append(piece)
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Encoder(dict):
    """Memo of words: a word's ids in decimal, each led by a space, and the UTF-8 of what they decode to."""

    def __init__(self, model: Model, cap: int = MEMO):
        super().__init__()
        self.model, self.cap, self.words = model, cap, re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.decoder = Decoder(model)
        self.decoder.begun = True  # a leading space is the text's matter, not a word's

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        model, decoder = self.model, self.decoder
        if len(word) > 2 and word[-1] in ".,;:!?" and word[-2:] not in model.inner:  # no piece holds both: a stable boundary
            (ids, text), (more, end) = self[word[:-1]], self[word[-1]]
            return ids + more, text + end
        ids = model.encode(word)
        out = b"".join(map(model.decimal.__getitem__, ids)), (decoder.feed(ids) + decoder.finish()).encode("utf-8")
        if len(word) <= WORD:
            if len(self) >= self.cap:
                self.clear()
            self[word] = out
        return out

    def round_trip(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Of a whole text, block by block: decimal ids, each led by a space, and decoded bytes; the end id comes last."""
        first = True
        for block in self.model.blocks(self.model.normalize(text)):
            found = [self[w] for w in (self.words.findall(block) if self.model.parted else [block])]
            ids, decoded = b"".join([x for x, _ in found]), b"".join([x for _, x in found])
            yield ids, decoded[1:] if first and decoded.startswith(b" ") else decoded
            first = False
        yield f" {self.model.end}".encode(), b""


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker process, so that its memo serves all tasks that the worker runs."""
    return Encoder(Model(path))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for), ids_sha256, decoded_sha256 for every row, as the sentencepiece library gives them.

    The end id closes each text and counts as a token; there is no begin id
    and no sampling. ids_sha256 is of the decimal ids joined by single spaces,
    decoded_sha256 of the decoded text in UTF-8. A null text counts as empty:
    the end id alone, which decodes to nothing. Repeated rows give repeated
    results, a null key stays null, other columns are ignored, empty input
    gives no rows. Map-only: no shuffle, one text in memory at a time, its
    words in blocks.
    """

    def run(batches):
        memo = encoder(path)
        for b in batches:
            n, ids, shas, decoded = [], [], [], []
            for t in b.column(1):
                size, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for i, d in memo.round_trip(t.as_py()):
                    of_ids.update(i if size else i[1:])
                    of_text.update(d)
                    size += i.count(b" ")
                    if with_ids:
                        kept += map(int, i.split())
                n.append(size)
                shas.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
                ids.append(kept)
            cols = [b.column(0), pa.array(n, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))).mapInArrow(run, schema)
