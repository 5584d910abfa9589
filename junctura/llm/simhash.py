"""SimHash near-dedup: 64-bit fingerprints, vantage-point trees, and connected components.

Fingerprints are computed in one scan. Distinct fingerprints (one row each, with the smallest doc_id)
are then partitioned by Hamming distance: a tree of `levels` vantage points, each with the median
distance of a sample as its radius, gives 2**levels shards. There are so many that a shard has about SHARD fingerprints
at most, and the sample has SAMPLE fingerprints for each shard (256 bytes, 8192 at least, by a hash). A
fingerprint is stored in one shard and asks all shards whose region may hold a fingerprint within
the radius; the triangle bounds |d(q, v) - d(x, v)| <= d(q, x) tell which. Of two shards only the one
with the larger number is asked. Every shard is searched by a local vantage-point tree with
the same bounds and links what it finds by union-find, so that a dense ball of fingerprints
yields one link per fingerprint, not one per pair. The links of all shards are joined into components
by alternating large-star and small-star steps over written tables.

A median split of 64-bit fingerprints leaves both sides open to about 47 % of the queries at radius 2, so a
search visits about n**0.56 fingerprints: exact at any size, but not linear. See the README.

Defined cases: texts without words (null texts, too) have fingerprint 0 and link like any other; fewer words than a
shingle make one shingle; a null doc_id is returned with its component but is no candidate for the
smallest doc_id; repeated rows and ties are rows of the same component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import Tables, blocks, ended_bytes, word_bounds

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Least levels of the tree over all shards, fingerprints of a shard that call for more, fingerprints for each shard that the tree
#: is fitted to, and those in a leaf of a shard's tree.
LEVELS, SHARD, SAMPLE, LEAF = 6, 1 << 16, 32, 64
#: Links (16 bytes each) that one task joins into components.
LAST_LINKS = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A byte's bits as eight byte-wide counters of one word.
_SPREAD = np.array([sum(1 << 8 * i for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run bounds[i]:bounds[i + 1] of 64-bit hashes the bits that over half of them have."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full) == 0:
        return out
    parts = -(-n[full] // 255)  # so that no counter of a byte overflows
    first = np.repeat(bounds[full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    group = np.cumsum(parts) - parts
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for octet in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, octet]], first).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), group, axis=0)
        bits = (2 * counts > n[full, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[full] |= np.bitwise_or.reduce(bits, axis=1) << np.uint64(8 * octet)
    return out


def fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("bytes")):
                starts, ends, at = word_bounds(data, offsets)
                # One space after each word: what stays is words, and the space that follows each.
                keep = np.zeros(len(data) + 1, np.int8)
                np.add.at(keep, starts, 1)
                np.add.at(keep, ends + 1, -1)
                keep = np.cumsum(keep[:-1]).astype(bool)
                flat = _LOWER[data]
                flat[ends] = 32
                flat = flat[keep].tobytes()
                length = ends - starts
                new_start = np.cumsum(length + 1) - length - 1
                new_end = new_start + length
                n = np.diff(at)
                shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
                bounds = np.concatenate(([0], np.cumsum(shingles)))
                at_word = np.repeat(at[:-1] - bounds[:-1], shingles) + np.arange(bounds[-1])
                last = np.minimum(at_word + shingle, np.repeat(at[1:], shingles)) - 1
                hashes = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(new_start[at_word].tolist(), new_end[last].tolist(), strict=True)), np.uint64, len(at_word))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(majority(hashes, bounds).view(np.int64))], ["doc_id", "fp"])

    return run


class _Tree:
    """The tree over all shards: vantage points and radii, by heap order."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.points, self.radii = np.zeros(1 << levels, np.uint64), np.zeros(1 << levels, np.int64)
        parts = {1: sample}
        for node in range(1, 1 << levels):
            part = parts.pop(node)
            if len(part) == 0:
                part = np.zeros(1, np.uint64)
            # Of a few candidates the one whose distances spread most prunes best.
            tried = part[:: max(1, len(part) // 16)][:16]
            far = np.bitwise_count(tried[:, None] ^ part[None, :]).astype(np.int64)
            best = int(np.argmax(far.std(axis=1)))
            self.points[node], self.radii[node] = tried[best], int(np.median(far[best]))
            parts[2 * node] = part[far[best] <= self.radii[node]]
            parts[2 * node + 1] = part[far[best] > self.radii[node]]

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, place in fps, stored there) for each fingerprint's own shard and for the later ones to ask."""
        node, place, own = np.ones(len(fps), np.int64), np.arange(len(fps)), np.ones(len(fps), bool)
        for _ in range(self.levels):
            off = np.bitwise_count(fps[place] ^ self.points[node]).astype(np.int64) - self.radii[node]
            home_right = off > 0
            left = (off <= radius) | (own & ~home_right)
            right = (off > -radius) | (own & home_right)
            node = np.concatenate((2 * node[left], 2 * node[right] + 1))
            own = np.concatenate(((own & ~home_right)[left], (own & home_right)[right]))
            place = np.concatenate((place[left], place[right]))
        shard = (node - (1 << self.levels)).astype(np.int32)
        home = np.zeros(len(fps), np.int32)
        home[place[own]] = shard[own]
        keep = own | (shard > home[place])
        return shard[keep], place[keep], own[keep]


def _routes(tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            shard, place, own = tree.value.route(fps, radius)
            yield pa.RecordBatch.from_pydict({"shard": shard, "fp": fps[place].view(np.int64), "stored": own})

    return run


def leaves(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves of a vantage-point tree over points, with the queries that reach each (both as places)."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        stored, asking = todo.pop()
        if len(asking) == 0 or len(stored) == 0:
            continue
        if len(stored) > LEAF:
            point = points[stored[len(stored) // 2]]
            far = np.bitwise_count(points[stored] ^ point)
            near = far <= np.median(far)
            if not near.all():
                off = np.bitwise_count(queries[asking] ^ point).astype(np.int64)
                inner, outer = int(far[near].max()), int(far[~near].min())
                todo.append((stored[near], asking[off <= inner + radius]))
                todo.append((stored[~near], asking[off >= outer - radius]))
                continue
            # Most are equally far from this point: halve them by another key; both halves are asked.
            todo += [(stored[0::2], asking), (stored[1::2], asking)]
            continue
        yield stored, asking


def root_of(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_within(stored: np.ndarray, asking: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all pairs within the radius: of stored ones to a root, of asking ones to roots."""
    stored = np.unique(stored)
    queries = np.concatenate((stored, np.setdiff1d(asking, stored)))
    parent, foreign = list(range(len(stored))), []
    for leaf, ask in leaves(stored, queries, radius):
        for part in range(0, len(ask), 4096):
            q = ask[part : part + 4096]
            i, j = np.nonzero(np.bitwise_count(queries[q, None] ^ stored[leaf][None, :]) <= radius)
            i, j = q[i], leaf[j]
            apart = i != j
            i, j = i[apart], j[apart]
            outside = i >= len(stored)
            for a, b in zip(i[~outside].tolist(), j[~outside].tolist(), strict=True):
                a, b = root_of(parent, a), root_of(parent, b)
                parent[max(a, b)] = min(a, b)
            if outside.any():
                roots = {b: root_of(parent, b) for b in set(j[outside].tolist())}
                foreign.append(np.unique(np.stack((i[outside], [roots[b] for b in j[outside].tolist()])), axis=1))
    roots = np.fromiter((root_of(parent, x) for x in range(len(stored))), np.int64, len(stored))
    own = np.flatnonzero(roots != np.arange(len(stored)))
    a, b = [stored[own]], [stored[roots[own]]]
    if foreign:
        i, j = np.unique(np.stack([*np.concatenate(foreign, axis=1)]), axis=1)
        i, j = np.unique(np.stack((i, roots[j])), axis=1)
        a, b = [*a, queries[i]], [*b, stored[j]]
    return np.concatenate(a), np.concatenate(b)


def _searched(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps, own = group["fp"].to_numpy().view(np.uint64), group["stored"].to_numpy()
        a, b = links_within(fps[own], fps[~own], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of the links of one task."""
    ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*([b.column(c).to_numpy() for c in ("a", "b")] for b in batches), strict=True)]
    if not ends:
        return
    nodes, at = np.unique(np.stack(ends), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in at.reshape(2, -1).T.tolist():
        low, high = sorted((root_of(parent, a), root_of(parent, b)))
        parent[high] = low
    roots = [root_of(parent, i) for i in range(len(nodes))]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], ["node", "root"])


def components(tables: Tables, links: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """(node, root) for each node of links(a, b): the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which end after O(log(n)**2)
    rounds, mostly three or four. Each step's minima are a table of their own, so the join's hot
    keys can be split or broadcast. As soon as at most `last` links are left, one task ends the search.
    """
    now, at, seen = tables.put("links0", links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), 0, None
    while True:
        checked = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if checked[0] == 0 or checked == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        if checked[0] <= last:
            return now.coalesce(1).mapInArrow(_connected, "node long, root long")
        seen = checked
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.put(f"large{at}", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = tables.put(f"star{at}", large)
        least = tables.put(f"small{at}", large.groupBy("a").agg(F.min("b").alias("least")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "least"), F.struct(F.col("a").alias("b"), "least"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.least").alias("b")).where("a <> b").distinct()
        after = tables.put(f"links{at + 1}", small)
        tables.drop(f"large{at}", f"star{at}", f"small{at}", f"links{at}")
        now, at = after, at + 1


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, levels: int | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id (the smallest doc_id reachable) of each row."""
    tables = Tables(spark, "simhash")
    texts = docs.select(F.col("doc_id").cast("long"), ended_bytes(F.col("text")).alias("bytes"))
    prints = tables.put("prints", texts.mapInArrow(fingerprints(shingle), "doc_id long, fp long"))
    distinct = tables.put("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if levels is None:
        levels = max(LEVELS, (distinct.count() // SHARD).bit_length())
    sample = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(8192, SAMPLE << levels)).collect()]
    tree = spark.sparkContext.broadcast(_Tree(np.array(sample, np.int64).view(np.uint64), levels))
    routed = distinct.select("fp").mapInArrow(_routes(tree, radius), "shard int, fp long, stored boolean")
    links = routed.groupBy("shard").applyInPandas(_searched(radius), "a long, b long")
    roots = tables.put("roots", components(tables, links).withColumnRenamed("node", "fp"))
    known = tables.put("known", roots.join(distinct, "fp"))
    smallest = tables.put("smallest", known.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = tables.put("linked", known.join(smallest, "root").select("fp", "component_id"))
    of = tables.put("of", distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
