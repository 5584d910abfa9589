"""Near-duplicates at a similarity: texts whose sets of five-word shingles have a Jaccard index of 4/5 or more.

At that index the fingerprints of whole texts differ in about ten of 64 bits, and at a radius that covers this no
bound of a vantage-point tree over all texts rules anything out. So each text has BLOCKS further fingerprints, each the
SimHash of the SAMPLE smallest shingle hashes of one part of its set (parts by hash). Two texts of index j have one of them
in common with a chance of about j**SAMPLE: of pairs at 4/5, one in a hundred thousand shares none of sixteen. Texts of an
equal block fingerprint are dealt into tiles of at most TILE texts; there, vantage-point trees over the
whole texts' fingerprints find the pairs within RADIUS bits, nearest pairs first, and those not connected yet are
verified by their shingles. Tiles emit links of a forest, never pairs.

The first blocks (FIRST of them) are searched first. Buckets of the others whose texts are connected by then
need no search, so that copies are not compared once per block. What lies in different tiles of a large bucket
is connected through its HUBS, which are in all its tiles, and in the end tiles that are not connected are compared by twos.

Defined cases: words are split and ASCII-lower-cased as for op6; fewer words than a shingle make one; texts
without words (null texts, too) are equal. A word is an XXH64 of its bytes, a shingle 64 bits of its words' hashes: unequal shingles
are equal by chance alone, and a row goes only if four fifths of its shingles are another's. Of a group stays one
row, that with the smallest doc_id (null is largest); of rows that repeat that, any one of equal rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import simhash
from junctura.llm.common import RollingHash, Tables, blocks, bounded, ended_bytes, mixed, word_bounds

SHINGLE = 5
BLOCKS, SAMPLE, FIRST, RADIUS = 16, 3, 2, 22
#: Texts, and shingles of them, that a task compares at a time, and texts of a bucket that are in all its tiles.
TILE, TILE_SHINGLES, HUBS = 256, 1 << 21, 8
#: Rows whose shingles a task holds at a time.
SLICE = 128

_ROLLING = RollingHash(5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted hashes of its different shingles) of each row of a batch."""
    for batch in batches:
        for first, _, data, offsets in blocks(batch.column("bytes")):
            at = word_bounds(data, offsets)[2]
            n = np.diff(at)
            count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
            bounds = np.concatenate(([0], np.cumsum(count)))
            begin = np.repeat(at[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
            lowered = _LOWER[data].tobytes().split()
            words = np.fromiter(map(xxhash.xxh64_intdigest, lowered), np.uint64, len(lowered))
            hashes = _ROLLING.slices(words, begin, np.minimum(begin + shingle, np.repeat(at[1:], count)))
            for i in range(len(n)):
                yield first + i, np.unique(hashes[bounds[i] : bounds[i + 1]])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, so that a task holds the hashes of few texts."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            yield batch.slice(first, SLICE)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def block_prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of sorted hashes a fingerprint of each part of it that is not empty, no two parts' alike."""
    found = np.concatenate(sets)
    part = np.repeat(np.arange(len(sets)) * BLOCKS, [len(x) for x in sets]) + (found & np.uint64(BLOCKS - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(len(sets) * BLOCKS + 1))
    count = np.minimum(np.diff(bounds), SAMPLE)
    held = np.concatenate(([0], np.cumsum(count)))
    sample = found[order[np.repeat(bounds[:-1] - held[:-1], count) + np.arange(held[-1])]]
    full = np.flatnonzero(count)
    prints = mixed(simhash.majority(mixed(sample), held)[full] + (full % BLOCKS).astype(np.uint64))
    return np.split(prints, np.searchsorted(full, np.arange(1, len(sets)) * BLOCKS))


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = [found for _, found in shingle_sets([batch], shingle)]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            own = [batch.column("doc_id"), batch.column("h"), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), _lists(block_prints(sets))]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "h", "digest", "size", "blocks"])

    return run


def _whole(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = [found for _, found in shingle_sets([batch], shingle)]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            prints = simhash.majority(mixed(np.concatenate(sets)), bounds)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints.view(np.int64)), _lists(sets)], ["node", "fp", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have an index of 4/5."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 5 * len(small) < 4 * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return 9 * int((large[at] == small).sum()) >= 4 * (len(a) + len(b)) if len(large) else True


def _tile_links(nodes: np.ndarray, roots: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the similar texts of a tile; equal roots are connected already."""
    known, roots = np.unique(roots, return_inverse=True)
    if len(known) == 1:
        return []
    parent, size, parts, links = list(range(len(known))), np.array([len(x) for x in sets]), [], []
    for leaf, asking in simhash.leaves(fps, fps, RADIUS):
        far = np.bitwise_count(fps[asking, None] ^ fps[leaf][None, :])
        i, j = np.nonzero(far <= RADIUS)
        d, i, j = far[i, j], asking[i], leaf[j]
        new = (i < j) & (roots[i] != roots[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
        parts.append(np.stack((d[new].astype(np.int64), i[new], j[new])))
    pairs = np.concatenate(parts, axis=1)
    for _, i, j in pairs[:, np.argsort(pairs[0], kind="stable")].T.tolist():
        a, b = simhash.root_of(parent, roots[i]), simhash.root_of(parent, roots[j])
        if a != b and similar(sets[i], sets[j]):
            parent[a] = b
            links.append((nodes[i], nodes[j]))
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all tiles of a partition, whose rows are in order of their tiles; one tile is held at a time."""

    def held() -> Iterator[tuple]:
        for batch in batches:
            lists = batch.column("hashes")
            values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            key, tile, node, root, fp = (batch.column(c).to_numpy() for c in ("key", "tile", "node", "root", "fp"))
            new = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(tile, prepend=~tile[:1]) != 0)) if len(key) else []
            for first, end in zip(new, [*new[1:], len(key)], strict=True):
                yield (key[first], tile[first]), node[first:end], root[first:end], fp[first:end].view(np.uint64), [values[a:b].copy() for a, b in zip(at[first:end], at[first + 1 : end + 1], strict=True)]

    def done(parts: list[tuple]) -> list[tuple[int, int]]:
        nodes, roots, fps = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        return _tile_links(nodes, roots, fps, [x for part in parts for x in part[3]])

    current, parts, links = None, [], []
    for tile, *part in held():
        if tile != current and parts:
            links += done(parts)
            parts = []
        current = tile
        parts.append(part)
        if len(links) >= 10_000:
            yield _pairs(links)
            links = []
    yield _pairs(links + (done(parts) if parts else []))


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in range(2)], ["a", "b"])


class _Search:
    """The texts' sets, the links found so far, and what they connect."""

    def __init__(self, tables: Tables, sets: DataFrame, nodes: DataFrame):
        self.tables, self.sets, self.nodes, self.links, self.at = tables, sets, nodes, None, 0
        self.roots = nodes.select("node", F.col("node").alias("root"))

    def _tiles(self, keyed: DataFrame) -> DataFrame:
        """keyed(key, node) of buckets that are not connected, with root and tile; hubs are in all tiles."""
        rows = self.tables.put(f"keyed{self.at}", keyed.join(self.roots, "node"))
        open_ = rows.join(self.nodes.select("node", "size"), "node").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
        open_ = self.tables.put(f"open{self.at}", open_.select("key", tiles.alias("tiles")))
        rows = rows.join(open_, "key")
        # A hub for each of HUBS classes of a bucket's texts: an aggregation, so no task orders a bucket.
        least = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "root", "tiles")).alias("hub")
        hubs = rows.where("tiles > 1").groupBy("key", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(HUBS)).alias("class")).agg(least)
        everywhere = hubs.select("key", "hub.*").select("key", "node", "root", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        own = rows.select("key", "node", "root", "tiles", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int").alias("tile"))
        return self.tables.put(f"tiles{self.at}", own.unionByName(everywhere).distinct())

    def _search(self, tiles: DataFrame) -> None:
        """Adds the links of the tiles (key, tile, node, root)."""
        dealt = tiles.join(self.sets, "node").repartition("key", "tile").sortWithinPartitions("key", "tile")
        found = dealt.mapInArrow(_linked, "a long, b long")
        found = self.tables.put(f"found{self.at}", found)
        self.links = found if self.links is None else self.links.unionByName(found)
        roots = self.tables.put(f"roots{self.at}", simhash.components(self.tables, self.links))
        self.roots = self.nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        self.roots = self.tables.put(f"all{self.at}", self.roots)
        self.tables.drop(f"keyed{self.at}", f"open{self.at}")
        self.at += 1

    def buckets(self, keyed: DataFrame) -> DataFrame:
        """Searches buckets tile by tile; returns the tiles of those with several."""
        tiles = self._tiles(keyed)
        self._search(tiles.select("key", "tile", "node", "root"))
        return tiles.where("tiles > 1").select("key", "tile", "tiles", "node")

    def across(self, tiled: DataFrame) -> None:
        """Compares tiles of a bucket by twos, where what they hold is not connected."""
        rows = self.tables.put(f"keyed{self.at}", tiled.join(self.roots, "node"))
        open_ = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        rows = rows.join(self.tables.put(f"open{self.at}", open_), "key")
        each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(o, F.col("tile")) * F.col("tiles") + F.greatest(o, F.col("tile")))
        self._search(rows.select("key", "node", "root", F.explode(each).alias("tile")).distinct())


def linked(tables: Tables, texts: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Of texts(doc_id, h, bytes): prints (doc_id, h, digest), and of each digest (node) its root and its first (none, doc_id, h)."""
    prints = tables.put("prints", texts.mapInArrow(_prints(shingle), "doc_id long, h long, digest binary, size long, blocks array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    different = prints.groupBy("digest").agg(first, F.first("size").alias("size"), F.first("blocks").alias("blocks"))
    different = tables.put("different", different.withColumn("node", F.monotonically_increasing_id()))
    keyed = different.select("node", "size", F.posexplode("blocks").alias("block", "key"))
    several = tables.put("several", keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keyed = tables.put("keyed", keyed.join(several, "key"))
    nodes = tables.put("nodes", different.select("node", "size", "first").join(keyed.select("node").distinct(), "node"))
    needed = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.h").alias("key"))
    found = texts.join(bounded(needed), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))).select("node", "bytes")
    sets = tables.put("sets", found.mapInArrow(_whole(shingle), "node long, fp long, hashes array<long>").dropDuplicates(["node"]))
    search = _Search(tables, sets, nodes)
    tiled = search.buckets(keyed.where(F.col("block") < FIRST).select("key", "node"))
    tiled = tiled.unionByName(search.buckets(keyed.where(F.col("block") >= FIRST).select("key", "node")))
    search.across(tiled)
    roots = different.select("digest", "node", "first").join(search.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = tables.put("of", roots)
    tables.drop("sets", "keyed", "several", "nodes", "different")
    return prints.select("doc_id", "h", "digest"), roots


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, all columns kept.

    Rows are named by doc_id and a hash of all columns; what is left out is joined back by these, so no text is
    moved where few rows are left out.
    """
    tables = Tables(spark, "near-copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long"), F.xxhash64(*columns).alias("h"))
    prints, roots = linked(tables, rows.select("doc_id", "h", ended_bytes(F.col("row.text")).alias("bytes")), shingle)
    best = roots.groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.doc_id").alias("id"), F.col("best.h").alias("key"))
    counted = prints.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))
    judged = tables.put("judged", counted.join(best, same, "left").where("key is null or n > 1").select(F.col("doc_id").alias("id"), F.col("h").alias("key"), F.col("key").isNotNull().alias("kept")))
    tables.drop("prints", "of")
    out = rows.join(bounded(judged.select("id", "key")), same, "left_anti").select("row")
    repeated = judged.where("kept").select("id", "key")
    if not repeated.isEmpty():  # of rows that are equal in all columns one stays
        out = out.unionByName(rows.join(bounded(repeated), same, "left_semi").dropDuplicates(["doc_id", "h"]).select("row"))
    return out.select([F.col("row").getField(c).alias(c) for c in docs.columns])
