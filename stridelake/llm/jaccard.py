"""Near-duplicates by Jaccard similarity of word shingles: SimHash candidates, verified exactly.

At similarity 0.8 two texts differ in about 15 of 100 SimHash bits, too many
for a 64-bit fingerprint to tell them from strangers. So the fingerprint here
has 256 bits; the tiled comparison of simhash finds candidates within 64 of
them, and each link is then verified on the shingle sets themselves.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stridelake.llm.common import Scratch, join_checked, spread, text_or_empty
from stridelake.llm.components import Forest, connected_components
from stridelake.llm.simhash import BLOCK, shingles, tile_links

SIZE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 differs by 39 bits, standard deviation 6; unrelated texts by 128, standard deviation 8.
WORDS, RADIUS = 4, 64
#: Sets and hashes of a tile of sets, at most (but for a single larger set).
TILE_SETS, TILE_HASHES = 512, 1 << 20
#: Bytes of sets for each task that builds tiles.
TASK_BYTES = 16 << 20
_SALTS = np.random.default_rng(42).integers(0, 1 << 63, WORDS, np.uint64)


def shingle_set(text: str | None, size: int = SIZE, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; empty for a text without words."""
    found, parts = shingles(text or "", size), []
    while len(h := np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in itertools.islice(found, BLOCK)), np.uint64)):
        parts.append(np.unique(h))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of WORDS words; a bit is one where over half of the set's hashes, mixed anew for each word, have it."""
    ones = np.zeros((WORDS, 64), np.int64)
    for lo in range(0, len(hashes), BLOCK // 4):
        for k, salt in enumerate(_SALTS):
            h = hashes[lo : lo + BLOCK // 4] ^ salt
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]


def sketches(docs: DataFrame, who: F.Column, text: str = "text", size: int = SIZE) -> DataFrame:
    """(who, text_id, sid, n, words) of every row: its set's identifier, size and wide fingerprint."""

    def run(batches):
        for b in batches:
            sids, sizes, words = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), size)
                sids.append(set_id(h))
                sizes.append(len(h))
                words.append(wide_simhash(h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64()))],
                names=["who", "text_id", "sid", "n", "words"],
            )

    t = text_or_empty(text)
    rows = spread(docs.select(who.alias("who"), F.xxhash64(t).alias("text_id"), t.alias("text")))
    more = [StructField("sid", LongType()), StructField("n", LongType()), StructField("words", ArrayType(LongType()))]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], *more]))


def candidate_links(distinct: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Links between sets (sid, n, words) within RADIUS bits.

    Sizes of similar sets differ by a factor of 1 / threshold at most: the
    cell is the size's class, and a tile visits its own class and the next.
    """
    step = -math.log(threshold) + 1e-9
    cell = F.floor(F.log("n") / step).cast("long")
    rows = distinct.filter("n > 0").select(cell.alias("cell"), F.concat(F.array("sid"), "words").alias("record"))
    return tile_links(rows, scratch, [1], RADIUS, WORDS)


def set_tiles(docs: DataFrame, wanted: DataFrame, scratch: Scratch, text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, block, blocks, members) with members (sid, hashes), from the texts of wanted (text_id, sid, n, key, block, blocks).

    Copies of a text are dropped in each task, and those of several tasks
    where they meet. One shuffle: the tiles are built where the sets arrive.
    """

    def run(batches):
        seen = set()
        for b in batches:
            new = [i for i, s in enumerate(b.column(1).to_pylist()) if s not in seen and not seen.add(s)]
            if new:
                b = b.take(pa.array(new))
                sets = pa.array([shingle_set(t.as_py(), size).view(np.int64) for t in b.column(0)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], sets], names=["sid", "key", "block", "blocks", "hashes"])

    t = text_or_empty(text)
    rows = docs.select(F.xxhash64(t).alias("text_id"), t.alias("text"))
    total = wanted.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * total // TASK_BYTES))
    found = join_checked(rows, wanted, ["text_id"], "inner").select("text", "sid", "key", "block", "blocks")
    sets = found.mapInArrow(run, "sid long, key long, block int, blocks int, hashes array<long>")
    return scratch.save(
        sets.repartition(tasks, "key", "block").dropDuplicates(["key", "block", "sid"])
        .groupBy("key", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("sid", "hashes")).alias("members")),
        "tiles",
    )


def similar_enough(common, left, right, threshold: float):
    return common >= threshold * (left + right - common) - 1e-9


class _Tile:
    """Sets of a tile, their trees, and the places of their hashes in the tile's own dictionary."""

    def __init__(self, members: pa.StructArray, roots: list[int] | None = None):
        hashes = members.field("hashes")
        ends = hashes.offsets.to_numpy()
        self.ids = members.field("sid").to_pylist()
        self.roots = roots or self.ids
        self.flat, self.sizes = hashes.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].copy(), np.diff(ends)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def index(self):
        self.distinct, self.local = np.unique(self.flat, return_inverse=True)

    def links(self, left: _Tile, forest: Forest, threshold: float):
        """Links between sets of left and of this tile, of pairs that are not yet connected."""
        for k, (a, root_a) in enumerate(zip(left.ids, left.roots)):
            root = forest.root(root_a)
            if all(forest.root(r) == root for r in self.roots):
                continue
            mine = left.flat[left.starts[k] : left.starts[k + 1]]
            place = np.searchsorted(self.distinct, mine)
            place = place[self.distinct[np.minimum(place, len(self.distinct) - 1)] == mine]
            mark = np.zeros(len(self.distinct), np.int64)
            mark[place] = 1
            common = np.add.reduceat(mark[self.local], self.starts[:-1])
            for j in np.nonzero(similar_enough(common, len(mine), self.sizes, threshold))[0].tolist():
                if forest.add(root_a, self.roots[j]):
                    yield a, self.ids[j]


def _links_table(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def compare_homes(threshold: float):
    """Links within each tile (column members)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = _Tile(batch.column(0)[k].values)
                tile.index()
                yield _links_table(list(tile.links(tile, Forest(), threshold)))

    return run


def compare_visits(threshold: float):
    """Rows (key, block, visitor, roots, members) arrive by home tile: the tile itself, then its visitors. Links between them."""

    def run(batches):
        home, at, forest = None, None, Forest()
        for batch in batches:
            keys, blocks, visitors, roots, members = batch.columns
            for r, (key, block, visitor, known) in enumerate(zip(keys.to_pylist(), blocks.to_pylist(), visitors.to_pylist(), roots.to_pylist())):
                tile = _Tile(members[r].values, known)
                if not visitor:
                    home, at, forest = tile, (key, block), Forest()
                    home.index()
                elif (key, block) == at:
                    yield _links_table(list(home.links(tile, forest, threshold)))

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", size: int = SIZE, row: str | None = None) -> DataFrame:
    """doc_id, component_id, kept for every row of docs.

    Rows link where the Jaccard similarity of their sets of word shingles is
    at least the threshold; component_id is the smallest key reachable, and
    its row is kept. A text of fewer words than a shingle is one shingle;
    texts without words are equal to each other. A null key names a component
    only if all its rows are null. Rows that repeat the kept key are kept too,
    unless `row` names a column that tells rows apart: then it is returned
    too, and one row of a component is kept. Empty input gives no rows.

    Sets that are linked by candidates are verified together, in tiles of a
    bounded number of hashes: first within each tile; then, in groups of
    several tiles that are still apart, each set with the least of its group;
    then, where that is not enough, tile with tile. Sets known to be
    connected are not compared again, so a crowd of copies costs one pass.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("long").alias("id"), (F.col(row) if row else F.lit(0)).alias("row"))
    every = scratch.save(sketches(docs, who, text, size), "sketches")
    distinct = scratch.save(every.groupBy("sid").agg(F.min("who").alias("first"), F.min("text_id").alias("text_id"), F.any_value("n").alias("n"), F.any_value("words").alias("words")), "distinct")
    candidates = candidate_links(distinct, scratch, threshold)
    near = scratch.save(connected_components(candidates, scratch), "near")
    members = distinct.join(near.select(F.col("node").alias("sid"), F.col("root").alias("key")), "sid").select("sid", "key", "text_id", "n")
    members = scratch.save(members, "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_HASHES)).cast("int")
    sizes = scratch.save(members.groupBy("key").agg(blocks.alias("blocks")), "sizes")
    wanted = join_checked(members, sizes, ["key"], "inner").select("text_id", "sid", "n", "key", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "blocks")
    tiles = set_tiles(docs, scratch.save(wanted, "wanted"), scratch, text, size)
    links = scratch.save(tiles.select("members").mapInArrow(compare_homes(threshold), "a long, b long"), "links")

    wide = tiles.filter("blocks > 1")
    if not wide.isEmpty():
        links = _links_between_tiles(wide, links, scratch, threshold)
    roots = connected_components(links, scratch)
    scratch.drop(tiles)

    rooted = scratch.save(roots.join(distinct.select(F.col("sid").alias("node"), "first"), "node"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = scratch.save(
        distinct.select("sid", "first").join(rooted.join(least, "root").select(F.col("node").alias("sid"), "least"), "sid", "left")
        .select("sid", F.coalesce("least", "first").alias("least")),
        "components",
    )
    for table in (distinct, candidates, near, members, links, rooted):
        scratch.drop(table)
    return join_checked(every.select("who", "sid"), named, ["sid"], "left").select(
        F.col("who.id").alias("doc_id"), F.col("least.id").alias("component_id"), (F.col("who") == F.col("least")).alias("kept"), *([F.col("who.row").alias(row)] if row else []),
    )


def _links_between_tiles(tiles: DataFrame, links: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """links, and enough more to connect what is similar across tiles of a group."""
    each = tiles.select("key", "block", "blocks", F.inline("members"))
    pivots = scratch.save(each.groupBy("key").agg(F.min_by(F.struct("sid", "hashes"), "sid").alias("p")).select("key", F.col("p.sid").alias("pivot"), F.col("p.hashes").alias("x")), "pivots")
    common = F.size(F.array_intersect("x", "hashes"))
    first = (
        join_checked(each, pivots, ["key"], "inner").filter("sid <> pivot").withColumn("common", common)
        .filter(similar_enough(F.col("common"), F.size("x"), F.size("hashes"), threshold)).select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    )
    links = scratch.save(links.unionByName(first), "links")
    known = connected_components(links, scratch).withColumnRenamed("node", "sid")
    placed = scratch.save(each.select("key", "block", "sid").join(known, "sid", "left").select("key", "block", "sid", F.coalesce("root", "sid").alias("root")), "placed")
    apart = scratch.save(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "apart")
    rooted = (
        join_checked(placed, apart, ["key"], "left_semi").groupBy("key", "block").agg(F.map_from_entries(F.collect_list(F.struct("sid", "root"))).alias("of"))
        .join(tiles, ["key", "block"])
        .select("key", "block", "blocks", F.transform("members", lambda m: F.element_at("of", m["sid"])).alias("roots"), "members")
    )
    rooted = scratch.save(rooted, "rooted-tiles")
    home = rooted.select("key", "block", F.lit(False).alias("visitor"), "roots", "members")
    visits = rooted.filter("block + 1 < blocks").select("key", F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("block"), F.lit(True).alias("visitor"), "roots", "members")
    more = home.unionByName(visits).repartition("key", "block").sortWithinPartitions("key", "block", "visitor").mapInArrow(compare_visits(threshold), "a long, b long")
    return scratch.save(links.unionByName(more), "links")
