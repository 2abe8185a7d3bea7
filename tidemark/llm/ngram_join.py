"""N-gram Jaccard join: exact links between texts whose shingle sets overlap enough, and their components.

Candidates come from size bands: within a band pair, two sets close enough differ in few elements, so if each set is dealt by hash
into more parts than that, at least one part is the same in both. Texts that share a part gather in groups; each group is cut into
tiles by size, and within a tile, or a pair of tiles whose sizes are compatible, hashed bitmap signatures bound every overlap from above
before sorted arrays are intersected. All of this is exact: no link is lost and none is made up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, map_batches, materialize, small_side
from .textvec import U64, mix, shingle_hashes, slices, word_hashes


@dataclass(frozen=True)
class JoinRules:
    """Sets of ``n``-word shingles link when ``100 * shared >= percent * union``. ``tile`` bounds the shingles of a tile, each text counting as ``fixed`` more;
    groups of up to ``sieve`` shingles (a quarter of a byte each) are sifted by bitmaps before any text is read for them."""

    n: int = 4
    percent: int = 85
    band: float = 1.5
    bitmap_words: int = 32
    tile: int = 400_000
    fixed: int = 64
    sieve: int = 40_000_000

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)

    def least_shared(self, a, b):
        """The least shared count of linked sets of these sizes."""
        return -((-self.percent * (a + b)) // (100 + self.percent))


@lru_cache(maxsize=4)
def _bands(rules: JoinRules, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band limits: sizes ``[limit[b], limit[b + 1])`` are in band b; ``parts[b]`` and ``spare[b]`` are for pairs whose smaller set is in b.

    Linked sets of sizes a <= b differ in at most ``a + b - 2 * least_shared`` elements, at most so many for the largest pair of
    the band. There are that many parts, one more, and a few spare ones, so that an equal part that is not empty can be asked for.
    """
    limits = [1]
    while limits[-1] < largest:
        limits.append(max(limits[-1] + 1, ceil(limits[-1] * rules.band)))
    parts, spare = [], []
    for hi in limits[1:]:
        a = hi - 1
        b = a * 100 // rules.percent
        differ = (100 - rules.percent) * (a + b) // (100 + rules.percent)
        empty = max(1, ceil(3 * (differ + 1) * np.exp(-max(a, 1) / (differ + 1)) + 2)) if differ else 0
        parts.append(differ + 1 + empty)
        spare.append(empty)
    return np.array(limits), np.array(parts), np.array(spare)


def part_keys(shingles: np.ndarray, rules: JoinRules) -> np.ndarray:
    """Keys of the parts of one sorted set: of its own band, and of the band below where a linked smaller set could lie in it."""
    limits, parts, spare = _bands(rules)
    size = len(shingles)
    own = int(np.searchsorted(limits, size, side="right")) - 1
    keys = []
    for band in (own, own - 1):
        if band < 0 or band < own and rules.percent * size > 100 * (limits[own] - 1):
            continue
        k = int(parts[band])
        edges = (np.arange(1, k, dtype=object) * (1 << 64) // k).astype(U64) if k > 1 else np.zeros(0, U64)
        cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [size]])
        total = np.concatenate([[U64(0)], np.cumsum(mix(shingles ^ U64(0xA5A5A5A5)))])
        sums = total[cuts[1:]] - total[cuts[:-1]]
        full = cuts[1:] > cuts[:-1]
        # equal parts outnumber the spare ones, so with no more empty parts than spares one that isn't empty is equal
        chosen = np.flatnonzero(full) if (~full).sum() <= spare[band] else np.arange(k)
        keys.append(mix(sums[chosen] + mix(chosen.astype(U64) * U64(2654435761) + U64(band + 1))))
    return np.concatenate(keys)


def _sets(column: pa.Array, rules: JoinRules) -> list[np.ndarray]:
    hashes, rows = word_hashes(column)
    shingles, bounds = shingle_hashes(hashes, rows, rules.n, len(column))
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bitmap of about two bits a shingle, a power of two in all: each shingle sets the bit its hash names. Halves of it, or-ed, make the next smaller."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    marks = np.zeros(bits, bool)
    marks[(shingles >> U64(20)).astype(np.int64) % bits] = True
    return np.packbits(marks, bitorder="little").tobytes()


_KEYS = "id bigint, n_shingles bigint, a bigint, b bigint, parts array<bigint>, bitmap binary"


def _set_keys(source: DataFrame, rules: JoinRules) -> DataFrame:
    """``(id, n_shingles, a, b, parts, bitmap)``: two hashes of the whole set, and its part keys and bitmap the first time a task meets the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, 1):
                a, b, n, keys, maps = [], [], [], [], []
                for s in _sets(part.column(1), rules):
                    x, y = (int((mix(s + U64(k)).sum() if len(s) else U64(0)).astype(np.int64)) for k in (1, 2))
                    a.append(x)
                    b.append(y)
                    n.append(len(s))
                    new = len(s) > 0 and (x, y) not in met
                    met.add((x, y))
                    keys.append(part_keys(s, rules).astype(np.int64) if new else None)
                    maps.append(bitmap(s) if new else None)
                lengths = np.concatenate([[0], np.cumsum([0 if k is None else len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, pa.array(maps, pa.binary())], names=["id", "n_shingles", "a", "b", "parts", "bitmap"])

    return map_batches(source, run, _KEYS)


class Tile:
    """Texts of a tile, by size: sorted shingle arrays and bitmaps in which a shingle sets the bit its hash names."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], group: list[int], rules: JoinRules):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.rules = rules
        self.ids = [ids[i] for i in order]
        self.sets = [sets[i] for i in order]
        self.group = np.array([group[i] for i in order])
        self.size = np.array([len(s) for s in self.sets])
        bits = 64 * rules.bitmap_words
        maps = np.zeros((len(ids), bits), dtype=bool)
        for row, s in zip(maps, self.sets):
            row[(s >> U64(20)).astype(np.int64) % bits] = True
        self._mark(np.packbits(maps, axis=1).view(U64))

    def _mark(self, bitmaps: np.ndarray) -> None:
        self.bitmaps = bitmaps
        self.set_bits = np.bitwise_count(bitmaps).sum(axis=1)

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that sizes and bitmaps let link with text ``i``.

        Each bit of one bitmap that the other lacks stands for a shingle the other lacks, so what both bitmaps lack of either set
        is taken off its size: an upper bound of the overlap.
        """
        need = self.rules.least_shared(self.size[i], self.size[others])
        others = others[np.minimum(self.size[i], self.size[others]) >= need]
        both = np.bitwise_count(self.bitmaps[others] & self.bitmaps[i]).sum(axis=1)
        most = np.minimum(self.size[i] - (self.set_bits[i] - both), self.size[others] - (self.set_bits[others] - both))
        return others[most >= self.rules.least_shared(self.size[i], self.size[others])]

    def linked(self, i: int, j: int) -> bool:
        shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return bool(self.rules.linked(shared, self.size[i], self.size[j]))

    def links(self) -> list[tuple[int, int]]:
        """Links that connect whatever this tile's links connect: a search that compares each text taken up with those not yet reached.

        Texts of one ``group`` count as connected from the start.
        """
        found = []
        waiting = np.arange(len(self.ids))
        while len(waiting):
            queue, at = [int(waiting[0])], 0
            waiting = waiting[1:]
            while at < len(queue):
                i = queue[at]
                at += 1
                same = waiting[(self.group[waiting] == self.group[i]) & (self.group[i] >= 0)]
                reached = set(same.tolist())
                rest = waiting[~np.isin(waiting, same)] if len(same) else waiting
                for j in self.candidates(i, rest).tolist():
                    if self.linked(i, j):
                        found.append((self.ids[i], self.ids[j]))
                        reached.add(j)
                if reached:
                    queue += sorted(reached)
                    waiting = waiting[~np.isin(waiting, list(reached))]
        return found


class Sieve(Tile):
    """Texts of a group by their bitmaps alone: what cannot link with any other is told without reading it."""

    def __init__(self, ids: list[int], sizes: list[int], maps: list[bytes], rules: JoinRules):
        order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
        self.rules, self.ids = rules, [ids[i] for i in order]
        self.size = np.array([sizes[i] for i in order])
        self.group = np.full(len(ids), -1)
        least = min(map(len, maps))
        folded = np.zeros((len(ids), least), np.uint8)
        for row, i in zip(folded, order):
            row[:] = np.bitwise_or.reduce(np.frombuffer(maps[i], np.uint8).reshape(-1, least), axis=0)
        self._mark(folded.view(U64))

    def linked(self, i: int, j: int) -> bool:
        return True  # as far as bitmaps tell

    def parts(self) -> list[tuple[int, int]]:
        """``(id, part)`` of the texts that could link with others; texts that link lie in one part, named by its first text."""
        part: dict[int, int] = {}
        for a, b in self.links():
            part[b] = part.setdefault(a, a)
        return list(part.items())


def _sieved(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """``(node, gang, part)`` of ``rows (gang, node, n_shingles, bitmap)`` that could link within their group, which is brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (found := Sieve(*zip(*held), rules).parts()):
                nodes, parts = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([key] * len(nodes), pa.int64()), pa.array(parts, pa.int64())], names=["node", "gang", "part"])

        key, held = None, []
        for batch in batches:
            for gang, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if gang != key:
                    yield from out()
                    key, held = gang, []
                held.append(row)
        yield from out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("gang", "node", "n_shingles", "bitmap").repartition(n, "gang").sortWithinPartitions("gang")
    return map_batches(dealt, run, "node bigint, gang bigint, part bigint")


def _tile_links(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """``(a, b)`` links within each tile of ``rows (tile_a, tile_b, tile_c, id, comp, text)``, which are brought together and sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        key, ids, sets, comps = None, [], [], []
        for batch in batches:
            for part in slices(batch, 5):
                keys = list(zip(*(part.column(k).to_pylist() for k in range(3))))
                for k, i, c, s in zip(keys, part.column(3).to_pylist(), part.column(4).to_pylist(), _sets(part.column(5), rules)):
                    if k != key and ids:
                        if found := Tile(ids, sets, comps, rules).links():
                            yield out(found)
                        ids, sets, comps = [], [], []
                    key = k
                    ids.append(i)
                    sets.append(s)
                    comps.append(c)
        if ids and (found := Tile(ids, sets, comps, rules).links()):
            yield out(found)

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("tile_a", "tile_b", "tile_c", "id", "comp", "text").repartition(n, "tile_a", "tile_b", "tile_c").sortWithinPartitions("tile_a", "tile_b", "tile_c")
    return map_batches(dealt, run, "a bigint, b bigint")


def similar_texts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules = JoinRules()) -> DataFrame:
    """One row for each distinct id: the id, ``n_shingles`` of its set, and ``component_id``, the smallest id reachable by links.

    Ids are integers. Rows with a null id are left out; of rows with one id the first text in order counts. A null or empty text has no
    shingle and links with nothing, a text of fewer than ``n`` words is one shingle. Only the two named columns are read.

    Texts of equal sets are one node throughout, so copies cost one row each. Nodes that share a part key (``part_keys``) are candidates:
    all that share it form a star around the one with the smallest set hash, and the stars of one centre are a group. So every link lies
    within a group, and bitmaps tell most texts of a group that link with none of it before they are read; and unlike texts that share a passage are not strung together into ever larger ones. A group is cut by size
    into tiles of bounded content. Links are found within each tile; then, where tiles of a group are not yet connected and sizes let
    texts of two tiles link, within each such pair of tiles, texts already connected not being compared again.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")
    keys = materialize(_set_keys(source, rules), "set-keys")
    # one row an id; repeated ids are rare, so only their texts are settled
    again = keys.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not again.isEmpty():
        twice = materialize(source.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "repeated-ids")
        source = source.join(again, "id", "left_anti").unionByName(twice)
        keys = materialize(_set_keys(source, rules), "set-keys")
    nodes = keys.where("n_shingles > 0").groupBy("a", "b").agg(F.min("id").alias("node"))
    nodes = materialize(nodes, "set-nodes")

    parts = keys.where("parts is not null").select("a", F.explode("parts").alias("part"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    star = (
        parts.repartition(n, "part").withColumn("centre", F.min("a").over(Window.partitionBy("part"))).where("a != centre").select("a", F.col("centre").alias("b")).distinct()
    )
    star = materialize(star, "stars")
    gangs = star.select("a", F.col("b").alias("gang")).unionByName(star.select(F.col("b").alias("a"), F.col("b").alias("gang")).distinct())
    maps = keys.where("bitmap is not null").groupBy("a", "b").agg(F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"))
    members = gangs.join(nodes.join(maps, ["a", "b"]).select("a", "node", "n_shingles", "bitmap"), "a").select("node", "gang", "n_shingles", "bitmap")
    members = materialize(members, "members")
    load = members.groupBy("gang").agg(F.sum(F.col("n_shingles") + rules.fixed).alias("load"))
    large = load.where(F.col("load") > rules.sieve).select("gang")
    sifted = _sieved(members.join(large, "gang", "left_anti"), rules).select("node", F.xxhash64("gang", "part").alias("gang"))
    members = sifted.unionByName(members.join(large, "gang", "left_semi").select("node", "gang"))

    sizes = keys.select(F.col("id").alias("node"), "n_shingles")
    running = Window.partitionBy("gang").orderBy("n_shingles", "node").rowsBetween(Window.unboundedPreceding, -1)
    tiled = members.join(sizes, "node").select(
        "node", "gang", "n_shingles", F.floor(F.coalesce(F.sum(F.col("n_shingles") + rules.fixed).over(running), F.lit(0)) / rules.tile).cast("bigint").alias("tile")
    )
    tiled = materialize(tiled, "tiles")
    rows = tiled.select(F.col("gang").alias("tile_a"), F.col("tile").alias("tile_b"), F.lit(0).alias("tile_c"), "node", F.lit(-1).cast("bigint").alias("comp"))
    links = materialize(_tile_links(_with_texts(rows, source), rules), "links")

    wide = tiled.groupBy("gang").agg(F.max("tile").alias("last")).where("last > 0").select("gang")
    if not wide.isEmpty():
        # one text of each connected part of each tile stands for it: most parts of a group of near copies meet here
        links = _meet(links, tiled, source, wide, rules, heads=True)
        links = _meet(links, tiled, source, wide, rules, heads=False)

    joined = components(links).select("node", F.col("component"))
    of_node = nodes.join(joined, "node", "left").select("a", "b", F.coalesce("component", "node").alias("component_id"))
    return keys.join(of_node, ["a", "b"], "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")
    )


def _with_texts(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of tiles with their texts."""
    named = small_side(materialize(rows, "tile-rows"))
    return source.join(named, source["id"] == named["node"]).select("tile_a", "tile_b", "tile_c", "id", "comp", "text")


def _meet(links: DataFrame, tiled: DataFrame, source: DataFrame, wide: DataFrame, rules: JoinRules, *, heads: bool) -> DataFrame:
    """``links`` and those found across tiles of groups of several tiles: between heads of their connected parts, or between all texts."""
    mine = tiled.join(wide, "gang", "left_semi")
    joined = components(links).select("node", "component")
    comp = mine.join(joined, "node", "left").select("node", "gang", "tile", "n_shingles", F.coalesce("component", "node").alias("comp"))
    comp = materialize(comp, "tile-parts")
    if heads:
        head = comp.groupBy("gang", "tile", "comp").agg(F.min(F.struct("n_shingles", "node")).alias("h")).select("gang", "comp", "h.n_shingles", "h.node")
        running = Window.partitionBy("gang").orderBy("n_shingles", "node").rowsBetween(Window.unboundedPreceding, -1)
        head = head.withColumn("tile", F.floor(F.coalesce(F.sum(F.col("n_shingles") + rules.fixed).over(running), F.lit(0)) / rules.tile).cast("bigint"))
        rows = head.select(F.col("gang").alias("tile_a"), F.col("tile").alias("tile_b"), F.lit(0).alias("tile_c"), "node", "comp")
    else:
        tile = comp.groupBy("gang", "tile").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.min("comp").alias("first"), F.max("comp").alias("last"))
        left, right = tile.alias("x"), tile.alias("y")
        apart = (F.col("x.first") != F.col("x.last")) | (F.col("y.first") != F.col("y.last")) | (F.col("x.first") != F.col("y.first"))
        close = F.col("y.lo") * rules.percent <= F.col("x.hi") * 100
        pairs = left.join(right, (F.col("x.gang") == F.col("y.gang")) & (F.col("x.tile") < F.col("y.tile")) & apart & close)
        pairs = pairs.select(F.col("x.gang").alias("gang"), F.col("x.tile").alias("tile_b"), F.col("y.tile").alias("tile_c"))
        member = pairs.select("gang", "tile_b", "tile_c", F.explode(F.array("tile_b", "tile_c")).alias("tile"))
        rows = member.join(comp, ["gang", "tile"]).select(F.col("gang").alias("tile_a"), "tile_b", "tile_c", "node", "comp")
    return materialize(links.unionByName(_tile_links(_with_texts(rows, source), rules)), "links")


def keep_one(docs: DataFrame, *, rules: JoinRules = JoinRules(n=5, percent=80)) -> DataFrame:
    """The rows of ``docs`` without those linked, directly or not, to a document of a smaller id. Rows with a null id stay."""
    gone = similar_texts(docs, rules=rules).where("component_id < doc_id").select(F.col("doc_id").alias("gone"))
    gone = materialize(gone, "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
