"""SimHash near-dedup: tiled exact comparison of fingerprints.

Fingerprints are cut into four 16-bit lanes. The four lane population counts
name a cell: two fingerprints within r bits lie in cells whose counts differ
by at most r in total, so tiles of all other cells are skipped. Tiles that
remain are compared with exclusive-or and bit counts over numpy arrays.

Every two fingerprints of near cells are compared, so the work grows with the
square of the distinct fingerprints (about a tenth of all pairs at radius 3).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch, join_checked, spread, text_or_empty
from stridelake.llm.components import Forest, connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
LANES, BLOCK = 4, 1 << 16
#: Fingerprints of a tile: half a megabyte, so that a shipped fingerprint meets many others.
TILE_ROWS = 1 << 16


def shingles(text: str, size: int) -> Iterator[str]:
    words = WORD.findall(text.translate(UPPER_TO_LOWER))
    if 0 < len(words) < size:
        return iter([" ".join(words)])
    return map(" ".join, zip(*(itertools.islice(words, i, None) for i in range(size))))


def simhash(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint as a signed integer; no words (or null) gives zero.

    Bit i is set where over half of the shingle hashes have it. Hashes are
    taken in blocks, so memory stays bounded for any length of text.
    """
    found, total, ones = shingles(text or "", size), 0, np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    while True:
        h = np.fromiter((one(s, seed) for s in itertools.islice(found, BLOCK)), np.uint64)
        if not len(h):
            break
        total += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]) if total else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = [simhash(t.as_py(), size, seed) for t in b.column(1)]  # one text at a time in Python
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))).mapInArrow(run, "doc_id long, fp long")


def _lanes() -> list[F.Column]:
    return [F.bit_count(F.shiftrightunsigned("fp", 64 // LANES * i).bitwiseAND(F.lit((1 << 64 // LANES) - 1))).cast("int").alias(f"p{i}") for i in range(LANES)]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Half of the non-zero lane offsets within the radius: of each two opposite ones, the later."""
    around = itertools.product(range(-radius, radius + 1), repeat=LANES)
    return [o for o in around if sum(map(abs, o)) <= radius and o > (0,) * LANES]


def _table(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def compare_tiles(radius: int, words: int = 1):
    """Rows arrive by home tile: the tile itself, then its visitors. Yields the links as (a, b).

    A fingerprint is one or more 64-bit words at the end of its record, which
    starts with its identifier (for one word, the word itself). Both sides
    are ordered by population count, and only the stretch of the other side
    whose counts are within the radius is compared.
    """
    width = words if words == 1 else words + 1

    def tile_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = flat.reshape(-1, width)
        ones = np.bitwise_count(rows[:, -words:]).sum(1, dtype=np.int64)
        order = np.argsort(ones, kind="stable")
        return rows[order, 0].view(np.int64), np.ascontiguousarray(rows[order, -words:].T), ones[order]

    def run(batches):
        home, at, forest, waiting, n_waiting = None, None, Forest(), [], 0

        def links(left, right, same: bool):
            ids, mine, ones = left
            others, theirs, their_ones = right
            step = max(1, (1 << 18) // max(len(others), 1))
            for lo in range(0, len(ids), step):
                hi = min(lo + step, len(ids))
                start = lo if same else int(np.searchsorted(their_ones, ones[lo] - radius))
                end = int(np.searchsorted(their_ones, ones[hi - 1] + radius, side="right"))
                if start >= end:
                    continue
                gap = np.bitwise_count(mine[0, lo:hi, None] ^ theirs[0, None, start:end])
                if words > 1:
                    gap = gap.astype(np.uint16)
                    for k in range(1, words):
                        gap += np.bitwise_count(mine[k, lo:hi, None] ^ theirs[k, None, start:end])
                near = gap <= radius
                if same:
                    near &= np.arange(lo, hi)[:, None] < np.arange(start, end)[None, :]
                i, j = np.nonzero(near)
                for a, b in zip(ids[i + lo].tolist(), others[j + start].tolist()):
                    if forest.add(a, b):
                        yield a, b

        def flush():
            nonlocal waiting, n_waiting
            if waiting and home is not None:
                yield from links(home, tile_of(np.concatenate(waiting)), False)
            waiting, n_waiting = [], 0

        for batch in batches:
            out: list[tuple[int, int]] = []
            cells, blocks, visitors, fps = batch.columns
            flat, ends = fps.values.to_numpy().view(np.uint64), fps.offsets.to_numpy()
            for r, (c, b, v) in enumerate(zip(cells.to_pylist(), blocks.to_pylist(), visitors.to_pylist())):
                tile = flat[ends[r] : ends[r + 1]]
                if not v:
                    out += flush()
                    home, at, forest = tile_of(tile), (c, b), Forest()
                    out += links(home, home, True)
                elif (c, b) == at:
                    waiting.append(tile.copy())
                    n_waiting += len(tile)
                    if n_waiting >= TILE_ROWS:
                        out += flush()
            if out:
                yield _table(out)
        if out := list(flush()):
            yield _table(out)

    return run


def tile_links(rows: DataFrame, scratch: Scratch, offsets: list[int], radius: int, words: int = 1) -> DataFrame:
    """Links (a, b) between the records of rows (cell, record) whose fingerprints differ by radius bits at most.

    Enough links to connect what the full set of pairs connects: each task
    keeps a spanning forest of what it finds, so a dense group of n
    fingerprints yields about n links a task, not n squared.

    A cell is dealt into blocks of about TILE_ROWS records; each block is the
    home of one comparison and visits the home blocks of the cells at
    cell + offset. The table of cells is broadcast if its bytes are few.
    """
    size = F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("blocks")
    cells = scratch.save(rows.groupBy("cell").agg(size), "cells")
    tiles = scratch.save(
        join_checked(rows, cells, ["cell"], "inner")
        .withColumn("block", F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int"))
        .groupBy("cell", "block").agg(F.flatten(F.collect_list("record")).alias("records")),
        "tiles",
    )
    home = tiles.select("cell", "block", F.lit(False).alias("visitor"), "records")
    # Visits within a cell go to the later blocks, visits between cells to all blocks.
    steps = F.array(*(F.lit(o).cast("long") for o in [0, *offsets]))
    visits = (
        join_checked(
            tiles.select("cell", F.col("block").alias("own"), "records", F.explode(steps).alias("step")).select((F.col("cell") + F.col("step")).alias("cell"), "own", (F.col("step") == 0).alias("same"), "records"),
            cells, ["cell"], "inner",
        )
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        .filter("not same or block > own")
        .select("cell", "block", F.lit(True).alias("visitor"), "records")
    )
    links = (
        home.unionByName(visits)
        .repartition("cell", "block")
        .sortWithinPartitions("cell", "block", "visitor")
        .mapInArrow(compare_tiles(radius, words), "a long, b long")
    )
    links = scratch.save(links, "links")
    scratch.drop(tiles)
    return links


def near_links(fps: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ by radius bits at most.

    The cell of a fingerprint is its four lane counts, written to a base so
    wide that no offset carries from one lane to the next: at most 17**4
    cells whatever the input.
    """
    base = 17 + 2 * radius
    cell = sum((F.col(f"p{i}").cast("long") * base**i for i in range(LANES)), F.lit(0).cast("long"))
    rows = fps.select("fp", *_lanes()).select(cell.alias("cell"), F.array("fp").alias("record"))
    return tile_links(rows, scratch, [sum(x * base**i for i, x in enumerate(o)) for o in _offsets(radius)], radius)


def near_duplicates(docs: DataFrame, radius: int = 3, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Rows link where fingerprints differ by radius bits at most; component_id
    is the smallest key reachable, the row's own included. Texts without words
    (null, empty) have fingerprint zero and link like any other. A null key
    gets a component too, but never names one unless all its rows are null.
    Repeated rows share a component. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    every = scratch.save(fingerprints(docs, key, text, size, seed), "fingerprints")
    distinct = scratch.save(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), scratch, radius), scratch)
    roots = scratch.save(
        roots.join(distinct, roots["node"] == distinct["fp"]).select("root", "fp", "first"), "roots"
    )
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(
        distinct.join(roots.join(least, "root").select("fp", "component_id"), "fp", "left")
        .select("fp", F.coalesce("component_id", "first").alias("component_id")),
        "components",
    )
    return join_checked(every, named, ["fp"], "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
