"""Exact top-k by inner product: KD-trees per shard, best-first traversal, a propagated k-th score.

The top of one KD-tree, fitted to a sample of at most SAMPLE vectors, deals the vectors to at most 2**LEVELS cells; a
cell's box is tight over all its vectors. A cell of more than SHARD_ROWS vectors is several shards, by a hash of vec_id.
Each shard has its own KD-tree: it splits at medians of its widest dimension, down to LEAF vectors, and keeps every node's tight bounding
box. The largest inner product that a box allows is sum(max(q * low, q * high)); nodes are visited in
the order of that bound until it falls below the k-th score found. Every query first searches the
cell with its highest bound, and takes its k-th score along to those other cells whose bound reaches it. Queries go to
shards in blocks of QUERY_ROWS, so a task holds one shard and one block, and a shard is sent to the blocks that ask it only.

Components are whole numbers in doubles; inner products are exact below 2**53.

Defined cases: null vectors, vectors with null or non-finite components, and null vec_ids take no part;
rows that repeat a vec_id are candidates each, and none is one for queries of that id; queries that repeat an id and a vector ask once, and those of one id with
several vectors share one list; vectors are compared only with those of their
own length; ties go to the smaller vec_id; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import Tables

K, SHARD_ROWS, QUERY_ROWS, LEAF = 5, 8192, 8192, 128
SAMPLE, LEVELS = 1 << 14, 10


def whole_units(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class KDTree:
    """Median splits with tight boxes; nodes in the order in which they are made."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.members: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        lows, highs = [], []
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            members, parent = todo.pop()
            node, own = len(self.members), self.points[members]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            if parent >= 0:
                first = self.children[parent]
                self.children[parent] = (node, -1) if first == () else (first[0], node)
            width = high - low
            if len(members) <= leaf or not width.any():
                self.members.append(members)
                self.children.append(None)
                continue
            values = own[:, int(np.argmax(width))]
            right = values > np.median(values)
            if not right.any():
                right = values >= np.median(values)
            self.members.append(None)
            self.children.append(())
            todo += [(members[right], node), (members[~right], node)]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that the node's box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) that reach kth, without the query's own id; ties to smaller ids."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            members = self.members[node]
            found = self.points[members] @ query
            good = (found >= kth) & (self.ids[members] != own)
            if good.any():
                ids, scores = np.concatenate((ids, self.ids[members][good])), np.concatenate((scores, found[good]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
        return ids, scores


def _searched(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            tree = KDTree(vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_list()).astype(np.float64))
            asked = np.stack(queries["v"].to_list()).astype(np.float64)
            bounds = tree.bounds(asked)
            for at, (own, kth) in enumerate(zip(queries["query_id"], queries["kth"], strict=True)):
                ids, scores = tree.search(own, asked[at], bounds[at], k, kth)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


class Cells:
    """The top of a KD-tree over vectors of one length: axes and medians, by heap order."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axes, self.cuts = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        parts = {1: sample}
        for node in range(1, 1 << levels):
            part = parts.pop(node)
            if len(part) and part.shape[1]:
                self.axes[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.cuts[node] = np.median(part[:, self.axes[node]])
                right = part[:, self.axes[node]] > self.cuts[node]
                parts[2 * node], parts[2 * node + 1] = part[~right], part[right]
            else:
                parts[2 * node] = parts[2 * node + 1] = part

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        if points.shape[1]:
            for _ in range(self.levels):
                node = 2 * node + (points[np.arange(len(points)), self.axes[node]] > self.cuts[node])
        return node - (1 << self.levels) if points.shape[1] else node * 0


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of a batch for each length."""
    lists = batch.column("v")
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, values[at[rows, None] + np.arange(n)[None, :]].astype(np.float64)


def _celled(tops):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for n, rows, points in _by_length(batch):
                if n in tops.value:
                    cell[rows] = tops.value[n].of(points)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], ["vec_id", "v", "cell"])

    return run


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's box of each cell: a row for each dimension."""
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        for n, rows, points in _by_length(batch):
            for c in np.unique(cell[rows]).tolist():
                own = points[cell[rows] == c]
                low, high = boxes.get((n, c), (own[0], own[0]))
                boxes[n, c] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
    for (n, c), (low, high) in boxes.items():
        yield pa.RecordBatch.from_pydict({"dim": np.full(n, n), "cell": np.full(n, c), "axis": np.arange(n), "low": low, "high": high})


def _routed(boxes, first: bool):
    """Queries (query_id, v, kth) by the cells to ask: that with the highest bound, or all others that reach kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = batch.column("kth").to_numpy(zero_copy_only=False)
            for n, rows, points in _by_length(batch):
                if n not in boxes.value:
                    continue
                cells, low, high = boxes.value[n]
                for part in range(0, len(rows), 512):
                    own, q = rows[part : part + 512], points[part : part + 512]
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    asked = np.zeros(bound.shape, bool)
                    asked[np.arange(len(q)), bound.argmax(axis=1)] = True
                    if not first:
                        asked = ~asked & (bound >= kth[own, None])
                    i, j = np.nonzero(asked)
                    taken = batch.take(pa.array(own[i]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells[j])], ["query_id", "v", "kth", "cell"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors other than its own.

    Both inputs have vec_id and v (an array of doubles); `queries` may be rows of `vectors`.
    """
    tables, context = Tables(spark, "topk"), spark.sparkContext
    usable_ = lambda df: df.select(F.col("vec_id").cast("long"), "v").where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    given = tables.put("given", usable_(vectors))
    counts = {r["dim"]: r["n"] for r in given.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    sample = given.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()
    tops = {}
    for dim, n in counts.items():  # vectors of rarer lengths are one cell for each
        own = np.array([r["v"] for r in sample if len(r["v"]) == dim], np.float64).reshape(-1, dim)
        tops[dim] = Cells(own, min(LEVELS, max(0, -(-n // shard_rows) - 1).bit_length(), (len(own) // 16).bit_length()))
    stored = tables.put("stored", given.mapInArrow(_celled(context.broadcast(tops)), "vec_id long, v array<double>, cell long"))
    rows = stored.mapInArrow(_boxed, "dim long, cell long, axis long, low double, high double")
    sides = rows.groupBy("dim", "cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = F.sort_array(F.collect_list(F.struct("axis", "low", "high")))
    boxes: dict[int, list] = {}
    for r in sides.groupBy("dim", "cell").agg(listed.alias("box")).orderBy("dim", "cell").collect():  # 2**LEVELS rows at most of a length
        boxes.setdefault(r["dim"], []).append((r["cell"], [x["low"] for x in r["box"]], [x["high"] for x in r["box"]]))
    boxes = {dim: tuple(np.array(x) for x in zip(*own, strict=True)) for dim, own in boxes.items()}
    keys = ["dim", "cell", "shard", "part"]
    dim = F.size("v").alias("dim")
    shards = stored.groupBy(dim, "cell").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    shards = F.broadcast(tables.put("shards", shards))  # a row for each cell
    placed = stored.withColumn("dim", dim).join(shards, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards"))).drop("shards")
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    asked = tables.put("asked", usable_(queries).distinct().select(F.col("vec_id").alias("query_id"), "v"))

    def searched(kth: DataFrame, first: bool) -> DataFrame:
        routed = kth.mapInArrow(_routed(context.broadcast(boxes), first), "query_id long, v array<double>, kth double, cell long")
        routed = routed.withColumn("dim", dim).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).join(shards, ["dim", "cell"])
        routed = tables.put("first" if first else "second", routed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards"))
        sent = placed.join(routed.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct().toDF(*keys), keys[:-1]).select("vec_id", "v", *keys)
        return sent.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(_searched(k), "query_id long, vec_id long, score long")

    found = tables.put("home", searched(asked.withColumn("kth", F.lit(float("-inf"))), True))
    if shards.count() > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
        again = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        found = found.unionByName(searched(again, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
