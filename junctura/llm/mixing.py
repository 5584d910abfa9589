"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

Each source's documents are put in an order given by a hash of doc_id and laid end to end on an axis of words; a block is
the documents that start in the same BLOCK_WORDS words of it. A target is a number of whole passes over the source (at most MOST
of them) and a rest. One keyed permutation (an MD5 under the seed) puts all blocks of a source in an order; a rank is a place in it, and each
pass goes through it once more. A source's quota is its number of ranks: all blocks for each whole pass, and as many from the front as the rest needs,
exactly (of the last one its first documents, and of the last of these its first words). A binary tree over the output shards splits the vector
of quotas: each node draws its left child's share from the multivariate hypergeometric distribution, so that all
splits together are one uniform draw without replacement. A shard takes the run of ranks that the tree gives it of each source: runs are disjoint between shards,
and what a document has in the mix is the sum over the shards. Documents are shuffled within their shard by a hash.

Sources are rows of a table, whatever their number: their order comes from range partitions, targets from one aggregation per
round of sharing, and the tree's vector has a colour per source or, beyond COLOURS sources, per group of them, whose permutations are
laid over one another, each from 0 to 1, so that every run has all of them in proportion. Running sums
go by hash buckets (BUCKETS of them in a source), so no task orders a whole source. A task of the tree yields TASK_SHARDS shards and
draws the nodes above them again from their seeds, so blocks are never listed in one place, and reruns agree.

Defined cases: null and empty texts have no words and are not taken; a null source is a source, ordered last; repeated
rows are documents of their own; extra columns stay in the mix, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import Tables, bounded, numbered, word_array, word_count

WEIGHTS, MOST = (1, 2, 3), 3
BLOCK_WORDS, SHARD_WORDS, SEED = 4096, 1 << 20, 5
BUCKET_BITS, COLOURS, TASK_SHARDS = 12, 4096, 16
#: numpy's hypergeometric draws are from fewer than this many.
_NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good ones; for large numbers by rejection (Stadlober's ratio of uniforms)."""
    total = good + bad
    if total < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    if sample in (0, total) or 0 in (good, bad):
        return min(good, sample)
    if 2 * good > total:
        return sample - hypergeometric(rng, bad, good, sample)
    if 2 * sample > total:
        return good - hypergeometric(rng, good, bad, total - sample)
    share = good / total
    centre = sample * share + 0.5
    width = math.sqrt((total - sample) * sample * share * (1 - share) / (total - 1) + 0.5)
    log = lambda k: sum(math.lgamma(x + 1) for x in (k, good - k, sample - k, bad - sample + k))
    mode = (sample + 1) * (good + 1) // (total + 2)
    least, spread, most = log(mode), 1.7155277699214135 * width + 0.8989161620588988, min(sample, good) + 1
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = centre + spread * (v - 0.5) / u
        if 0 <= x < most and 2 * math.log(u) <= least - log(math.floor(x)):
            return math.floor(x)


@dataclass
class SplittingTree:
    """Exact quotas of blocks, split among shards."""

    quotas: list[int]
    shards: int
    seed: int

    def _upto(self, shard: int) -> int:
        return sum(self.quotas) * shard // self.shards

    def _left(self, rng: np.random.Generator, quotas: np.ndarray, sample: int) -> np.ndarray:
        """One draw of `sample` blocks, colour by colour."""
        rest, out = int(quotas.sum()), np.zeros_like(quotas)
        for i, q in enumerate(quotas.tolist()):
            if sample == 0:
                break
            rest -= q
            out[i] = hypergeometric(rng, q, rest, sample) if q else 0
            sample -= int(out[i])
        return out

    def leaves(self, first: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, first rank of each colour, number of ranks of each) of the shards in first:end."""
        todo = [(0, self.shards, np.array(self.quotas, np.int64), np.zeros(len(self.quotas), np.int64))]
        while todo:
            low, high, quotas, ranks = todo.pop()
            if high <= first or low >= end:
                continue
            if high - low == 1:
                yield low, ranks, quotas
                continue
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left = self._left(rng, quotas, self._upto(middle) - self._upto(low))
            todo += [(middle, high, quotas - left, ranks + left), (low, middle, left, ranks)]


def _rank_rows(tree: SplittingTree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch["id"]:
                for shard, ranks, quotas in tree.leaves(TASK_SHARDS * task, TASK_SHARDS * (task + 1)):
                    before = np.repeat(ranks - (np.cumsum(quotas) - quotas), quotas)
                    yield pd.DataFrame({"colour": np.repeat(np.arange(len(quotas)), quotas), "rank": before + np.arange(quotas.sum()), "shard": shard})

    return run


def _hash(*parts: Column) -> Column:
    """32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def _with_start(tables: Tables, name: str, rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds `start`, the sum of `value` over the rows of the same sid that come before by (h, order), and `place` within a bucket of h."""
    rows = rows.withColumn("bucket", F.shiftright("h", 32 - BUCKET_BITS))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("sid", "bucket").agg(F.sum(value).alias("words"))
    offsets = tables.put(name, sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start")))
    within = Window.partitionBy("sid", "bucket").orderBy("h", *order)
    start = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"place": F.row_number().over(within), "start": start}).join(offsets, ["sid", "bucket"])
    return placed.withColumn("start", F.col("start") + F.col("bucket_start")).drop("bucket_start")


def with_targets(tables: Tables, sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sid (the source's number by code point, null last), source, source_size and target.

    Shares of all words are by weight; what exceeds `most` times a source's size is shared anew by weight until none does.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(tables, "sources", sizes, [F.asc_nulls_last("source")], "sid")
    rows = tables.put("weighed", ranked.withColumn("weight", F.get(listed, (F.col("sid") % len(weights)).cast("int")).cast("long")))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    state = (0, 0, None)
    while True:
        capped = F.lit(False)
        if state[2] is not None:
            capped = most * exact("source_size") * F.lit(state[1]).cast("decimal(20,0)") <= exact("weight") * F.lit(state[0]).cast("decimal(20,0)")
        found = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("out"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(capped).alias("n"),
        ).first()
        before, state = state, ((found["all"] or 0) - most * (found["out"] or 0), found["open"] or 0, found["n"])
        if before[2] == state[2]:
            break
    level = state[0] / state[1] if state[1] else 0.0
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return tables.put("targets", rows.select("sid", "source", "source_size", target.alias("target")))


def draws(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Each row of docs as often as it is taken, once with null `shard` if it is not.

    doc_id, k1 and k2 (two hashes of all columns), place (unique with them), size, source_size, target,
    copy, n_words (its first words that this copy takes), shard, shuffle_key.
    """
    tables = Tables(spark, "mixing")
    sized = docs.select("doc_id", *row_keys(docs), "source", word_count(F.col("text")).alias("size"), _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    sized = tables.put("sized", sized)
    sources = with_targets(tables, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    take = F.floor(F.col("target") + 0.5)
    passes = F.coalesce(F.floor(take / F.col("source_size")), F.lit(0)).cast("long")
    # A target is at most MOST times the size; division by doubles is mended by one step.
    passes = F.when(passes * F.col("source_size") > take, passes - 1).otherwise(passes)
    sources = tables.put("quotas", sources.withColumns({"passes": passes, "rest": take - passes * F.col("source_size")}))
    own = bounded(sources.withColumnRenamed("source", "named"))
    named = sized.join(own, sized["source"].eqNullSafe(own["named"])).drop("named", "source", "passes", "rest")
    placed = _with_start(tables, "offsets", named, ["doc_id", "size", "k1"], "size").withColumn("block", F.floor(F.col("start") / block_words))
    placed = tables.put("placed", placed.withColumn("place", F.concat_ws("-", "sid", "bucket", "place")).drop("h", "bucket"))
    blocks = placed.where("size > 0").groupBy("sid", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first"))
    blocks = _with_start(tables, "block_offsets", blocks.withColumn("h", _hash(F.lit(seed), F.col("sid"), F.col("block"))), ["block"], "words")
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda c: F.struct(c.alias("copy"), F.when(c < F.col("passes"), F.col("words")).otherwise(F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("start")))).alias("taken")),
    )
    drawn = blocks.join(bounded(sources.select("sid", "passes", "rest")), "sid")
    drawn = drawn.select("sid", "block", "first", "h", "passes", F.explode(F.filter(copies, lambda c: c["taken"] > 0)).alias("c"))
    along = (F.col("c.copy") + F.col("h") / (1 << 32)) / (F.col("passes") + 1)
    drawn = drawn.select("sid", "block", "first", "h", "c.*", (F.col("sid") % COLOURS).alias("colour"), along.alias("along"))
    drawn = numbered(tables, "drawn", drawn, ["colour", "along", "sid", "copy", "h", "block"], "rank")
    colours = {r["colour"]: (r["n"], r["low"]) for r in drawn.groupBy("colour").agg(F.count("*").alias("n"), F.min("rank").alias("low")).collect()}  # COLOURS rows at most
    quotas = [colours.get(c, (0, 0))[0] for c in range(max(colours, default=-1) + 1)]
    tree = SplittingTree(quotas, max(1, -(-sum(quotas) * block_words // shard_words)), seed)
    tasks = -(-tree.shards // TASK_SHARDS)
    ranks = spark.range(0, tasks, 1, tasks).mapInPandas(_rank_rows(tree), "colour long, rank long, shard long")
    starts = F.array(*[F.lit(colours.get(c, (0, 0))[1]).cast("long") for c in range(len(quotas))]) if quotas else F.array(F.lit(0).cast("long"))
    drawn = drawn.withColumn("rank", F.col("rank") - F.get(starts, F.col("colour").cast("int")))
    chosen = tables.put("chosen", drawn.join(ranks, ["colour", "rank"]).select("sid", "block", "first", "copy", "taken", "shard"))
    joined = placed.join(chosen, ["sid", "block"], "left")
    n_words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - (F.col("start") - F.col("first"))))
    shuffle = F.xxhash64(F.lit(seed), "sid", "block", "doc_id", "k1", "place", "copy")
    shard = F.when(F.col("n_words") > 0, F.col("shard")).alias("shard")
    return joined.withColumn("n_words", n_words).select("doc_id", "k1", "k2", "place", "size", "source_size", "target", "copy", "n_words", shard, shuffle.alias("shuffle_key"))


def row_keys(docs: DataFrame) -> list[Column]:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def taken_words(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words that the shards of the mix have of it) and shards of each row.

    shards lists them as `shard:words`, comma-joined, in order of the shards' numbers; it is empty where nothing is taken.
    """
    row = ["place", "doc_id", "size", "source_size", "target"]
    by_shard = draws(spark, docs, **options).groupBy(*row, "shard").agg(F.sum("n_words").alias("n"))
    part = F.when(F.col("shard").isNotNull(), F.struct("shard", "n"))
    found = by_shard.groupBy(*row).agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a row's copies, MOST + 1 at most
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"]).alias("taken")
    listed = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["shard"], x["n"])), ",").alias("shards")
    return found.select("doc_id", "size", "source_size", "target", taken, listed)


def mixture(spark: SparkSession, docs: DataFrame, with_shard: bool = False, **options) -> DataFrame:
    """The mix: rows of docs with their own columns, repeated as drawn, shuffled within their shard.

    The last document of a source's rest has its first words only, joined by a space, and
    n_chars, where it is there, follows. with_shard adds `shard`, the output shard's number.
    """
    plan = draws(spark, docs, **options).where("shard is not null").select("k1", "k2", "shard", "shuffle_key", "n_words", "size")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Rows that are equal in all columns share their keys, and one of them stands for all; the join keeps its partitions.
    one = docs.select(*row_keys(docs), row).dropDuplicates(["k1", "k2"])
    dealt = one.join(plan.hint("shuffle_merge"), ["k1", "k2"]).repartition(F.col("shard")).sortWithinPartitions("shard", "shuffle_key")
    cut = F.col("n_words") < F.col("size")
    text = F.array_join(F.slice(word_array(F.col("row.text")), F.lit(1), F.col("n_words").cast("int")), " ")
    columns = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.when(cut, text).otherwise(column)
        elif c == "n_chars":
            column = F.when(cut, F.length(text).cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return dealt.select(*columns, *([F.col("shard")] if with_shard else []))
