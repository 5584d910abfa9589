"""Substring dedup by compaction of a de Bruijn graph of word k-mers.

The windows to find are WINDOW consecutive words long. Edges of the graph are word k-mers of EDGE
words; of each window, the k-mer with the smallest hash is kept (a minimizer), so that equal windows
keep the same edge and about one k-mer of sixteen is stored. Links join edges that follow each other
in a document. A link is nonbranching if all occurrences of either edge have it. A repeated edge has a source, its first place in the
document with the smallest doc_id, and nonbranching links compact the repeated edges of a source document into
numbered paths. A join brings source and path to all occurrences: a run of windows along one path is one span, with the place in the
source that it repeats, and it is removed only after its words are compared with the source's words there.

Windows that leave a path are judged one by one, by a cryptographic digest of their words. If a span's words differ from its
source's (by equal hashes of unequal words), all windows of that path are judged so, too. So no result rests on a 64-bit hash.

Steps, each a distributed job: (1) edges of all documents, written once; (2) one row for each edge
that at least two documents hold, with its source, and paths by a window over each source document; (3) a join
to the occurrences, gathered by document (at most as many as the document has words) and joined to its
text; (4) spans along paths, the paths' words, and digests of the windows outside; (5) spans joined to their paths and compared; (6) the smallest document of each of
those windows, joined back; (7) removal. All aggregates are combined before the shuffle, and the
joins' hot keys can be split because both sides are plain tables.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a row with a null
doc_id is returned as it is and removes nothing; rows that repeat a doc_id are judged each by
itself (told apart by a hash of their texts), and only against smaller doc_ids. Extra columns of any name are ignored (or kept, with
`documents=True`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import RollingHash, Tables, blocks, ended_bytes, word_bounds

WINDOW, EDGE = 50, 20
#: Spans are compared in pieces of so many words of their source, so that no row grows with a text.
PIECE = 128
_ROLLING = RollingHash(11)


def _minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of keys[i : i + width], the last of equal ones, for every i."""
    n = len(keys) - width + 1
    least, place, span = keys, np.arange(len(keys)), 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] <= least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    return place[:n]


class _Block:
    """A block of texts as word hashes, with its windows and edges."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, edge: int, bits: int):
        self.texts = data.tobytes().split()
        _, _, self.first = word_bounds(data, offsets)
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, self.texts), np.uint64, len(self.texts)) >> np.uint64(64 - bits)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(self.words)
        if n < window:
            self.windows = self.minimizer = self.edges = np.zeros(0, np.int64)
            return
        self.keys = _ROLLING.windows(self.words, edge)
        at = np.arange(n - window + 1)
        inside = at + window <= self.first[self.row[at] + 1]
        self.windows = at[inside]
        self.minimizer = _minimizers(self.keys, window - edge + 1)[inside]
        new = np.ones(len(self.minimizer), bool)
        new[1:] = self.minimizer[1:] != self.minimizer[:-1]
        self.edges = self.minimizer[new]

    def links(self, edge: int) -> tuple[np.ndarray, np.ndarray]:
        """For each edge the link to the next and to the previous one: a hash of all words of both, or 0.

        Two edges may be further apart than an edge is long, so the words between them count, too.
        """
        row = self.row[self.edges]
        near = row[1:] == row[:-1]
        link = np.where(near, _ROLLING.slices(self.words, self.edges[:-1], self.edges[1:] + edge), np.uint64(0))
        after, before = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        after[:-1], before[1:] = link, link
        return after, before

    def joined(self, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The words of slices, with a space between them."""
        flat = b" ".join(self.texts)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + 1)))
        return map(flat.__getitem__, map(slice, at[starts].tolist(), (at[ends] - 1).tolist()))


def _edge_rows(window: int, edge: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_key = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for first, _, data, offsets in blocks(batch.column("bytes")):
                b = _Block(data, offsets, window, edge, bits)
                if len(b.edges) == 0:
                    continue
                after, before = b.links(edge)
                row = b.row[b.edges]
                yield pa.RecordBatch.from_pydict({
                    "key": b.keys[b.edges].view(np.int64), "doc_id": doc[first + row], "text_key": text_key[first + row],
                    "pos": (b.edges - b.first[row]).astype(np.int32), "after": after.view(np.int64), "before": before.view(np.int64),
                })

    return run


#: A row of (4): a span along a path with its words and its place in the source (or of the source itself, if it starts there), or a window's digest.
_FOUND = "doc_id long, text_key long, start int, stop int, s_doc long, s_key long, s_start int, path int, words binary, digest binary"


def _cut_at_pieces(ends: np.ndarray, s: np.ndarray, r: np.ndarray, start: np.ndarray, source: np.ndarray) -> list[np.ndarray]:
    """Spans as pieces: none crosses a multiple of PIECE in its source."""
    stop = start + ends - s
    low = start // PIECE
    n = (stop - 1) // PIECE - low + 1
    which = np.repeat(np.arange(len(s)), n)
    piece = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
    begin = np.maximum(start[which], piece * PIECE)
    end = np.minimum(stop[which], (piece + 1) * PIECE)
    shift = (s - start)[which]
    return [end + shift, begin + shift, r[which], begin, source[which]]


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _window_rows(window: int, edge: int, bits: int):
    """Spans along paths (repeats and their sources), and the windows outside of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_key = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            shared = batch.column("shared")
            at, fields = shared.offsets.to_numpy().astype(np.int64), shared.values
            pos, s_doc, s_key, s_pos, path = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            for first, end, data, offsets in blocks(batch.column("bytes")):
                b = _Block(data, offsets, window, edge, bits)
                if len(b.windows) == 0:
                    continue
                own = np.arange(at[first], at[end])
                place = pos[own] + np.repeat(b.first[:-1], np.diff(at[first : end + 1]))
                known = np.full(len(b.words), -1)  # the shared edge that starts at a word, as a place in the lists
                known[place] = own
                e = b.edges
                k, before = known[e], np.concatenate(([-1], known[e[:-1]]))
                linked = (k >= 0) & (before >= 0)
                linked[1:] &= b.row[e[1:]] == b.row[e[:-1]]
                linked &= (s_doc[k] == s_doc[before]) & (s_key[k] == s_key[before]) & (path[k] == path[before]) & (path[k] >= 0)
                linked[1:] &= s_pos[k[1:]] - s_pos[before[1:]] == e[1:] - e[:-1]
                runs = np.cumsum(~linked)
                candidate = known[b.minimizer] >= 0
                w, m = b.windows[candidate], b.minimizer[candidate]
                k, row = known[m], b.row[w]
                left = np.searchsorted(e, w, "right") - 1
                right = np.searchsorted(e, w + window - edge, "left")
                inside = (left >= 0) & (right < len(e)) & (path[k] >= 0)
                inside[inside] = runs[left[inside]] == runs[right[inside]]
                mine = (s_doc[k] == doc[first + row]) & (s_key[k] == text_key[first + row]) & (s_pos[k] == m - b.first[row])
                for chosen, digested in ((inside & (mine | (s_doc[k] < doc[first + row])), False), (~inside, True)):
                    s, r, source = w[chosen], row[chosen], k[chosen]
                    if len(s) == 0:
                        continue
                    start, ends = s_pos[source] - (m[chosen] - s), s + window
                    if not digested:
                        new = np.ones(len(s), bool)
                        new[1:] = (s[1:] != s[:-1] + 1) | (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1) | (mine[chosen][1:] != mine[chosen][:-1])
                        for x in (s_doc, s_key, path):
                            new[1:] |= x[source[1:]] != x[source[:-1]]
                        last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
                        ends, s, r, start, source = _cut_at_pieces(ends[last], s[new], r[new], start[new], source[new])
                    words = b.joined(s, ends)
                    base, nothing = b.first[r], pa.nulls(len(s), pa.binary())
                    words, digests = (nothing, pa.array(map(_digest, words), pa.binary())) if digested else (pa.array(words, pa.binary()), nothing)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": doc[first + r], "text_key": text_key[first + r], "start": (s - base).astype(np.int32), "stop": (ends - base).astype(np.int32),
                        "s_doc": s_doc[source], "s_key": s_key[source], "s_start": start.astype(np.int32), "path": path[source], "words": words, "digest": digests,
                    })

    return run


def _unequal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of spans whose words are not the source's words at their place."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("words", "source_words", "at")), strict=True)
        wrong = [source is None or at < 0 or (own := words.split(b" ")) != source.split(b" ")[at : at + len(own)] for words, source, at in rows]
        yield batch.select(["s_doc", "s_key", "path"]).filter(pa.array(wrong, pa.bool_()))


def _removals(documents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            at = spans.offsets.to_numpy().astype(np.int64)
            start, stop = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for row, data in enumerate(batch.column("bytes")):
                raw = data.as_py()
                words = raw.split()
                gone = 0
                if at[row] < at[row + 1]:
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, start[at[row] : at[row + 1]], 1)
                    np.add.at(change, stop[at[row] : at[row + 1]], -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    if documents:
                        kept_texts.append(_cut(raw, keep))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                elif documents:
                    kept_texts.append(raw[:-1].decode("utf-8", "replace"))
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                if not documents:
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            out |= {"kept_text": pa.array(kept_texts, pa.string())} if documents else {"kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out.values()], ["row", *out])

    return run


def _cut(raw: bytes, keep: np.ndarray) -> str:
    """The text without the words that are not kept; the space before a removed run stays."""
    starts, _, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    starts = np.append(starts, len(raw) - 1)
    turn = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
    pieces, at = [], 0
    for first, end in zip(turn[0::2], turn[1::2], strict=True):
        pieces.append(raw[at : starts[first]])
        at = starts[end]
    return b"".join([*pieces, raw[at:-1]]).decode("utf-8", "replace")


def compacted(edges: DataFrame) -> DataFrame:
    """key, s_doc, s_key, s_pos and path of each edge that at least two documents hold.

    The first three name its source; edges of a path follow each other there by nonbranching links.
    """
    shared = edges.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_key", "pos")).alias("s"), F.max("doc_id").alias("most"),
        *[f(c).alias(f"{c}_{n}") for c in ("after", "before") for n, f in (("low", F.min), ("high", F.max))],
    ).where("s.doc_id < most")
    rows = shared.select("key", F.col("s.doc_id").alias("s_doc"), F.col("s.text_key").alias("s_key"), F.col("s.pos").alias("s_pos"), "after_low", "after_high", "before_low", "before_high")
    order = Window.partitionBy("s_doc", "s_key").orderBy("s_pos", "key")
    follows = (F.lag("after_low").over(order) == F.col("before_low")) & (F.lag("after_high").over(order) == F.col("before_high")) & (F.col("before_low") == F.col("before_high")) & (F.col("before_low") != 0)
    marked = rows.withColumn("starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    return marked.select("key", "s_doc", "s_key", "s_pos", F.sum("starts").over(order).cast("int").alias("path"))


def _judged(tables: Tables, known: DataFrame, edges: DataFrame, paths: DataFrame, window: int, edge: int, bits: int) -> DataFrame:
    """The rows of (4), in which every span has the words of its source."""
    at = ["s_doc", "s_key", "path"]
    for turn in range(2):
        found = (
            edges.select("key", "doc_id", "text_key", "pos").join(paths, "key")
            .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "s_doc", "s_key", "s_pos", "path")).alias("shared"))
        )
        gathered = known.join(found, ["doc_id", "text_key"]).select("doc_id", "text_key", "bytes", "shared")
        rows = tables.put(f"windows{turn}", gathered.mapInArrow(_window_rows(window, edge, bits), _FOUND))
        spans = rows.where("words is not null").withColumn("piece", F.floor(F.col("s_start") / PIECE))
        sources = spans.where("s_doc = doc_id and s_key = text_key").select(*at, "piece", F.col("start").alias("from"), F.col("words").alias("source_words")).dropDuplicates([*at, "piece"])
        repeats = spans.where("s_doc < doc_id").join(sources, [*at, "piece"], "left").select(*at, "words", "source_words", (F.col("s_start") - F.coalesce("from", F.lit(0))).alias("at"))
        wrong = tables.put(f"wrong{turn}", repeats.mapInArrow(_unequal, "s_doc long, s_key long, path int").distinct())
        if wrong.isEmpty():
            break
        # Unequal words with equal hashes: no path there is trusted, all its windows are judged by their words.
        marked = paths.join(wrong.withColumn("bad", F.lit(True)), at, "left")
        paths = tables.put("mended", marked.select("key", "s_doc", "s_key", "s_pos", F.when(F.col("bad"), F.lit(-1)).otherwise(F.col("path")).alias("path")))
    return rows


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, edge: int = EDGE, documents: bool = False, bits: int = 64) -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller doc_id.

    Returns a row for each row of docs: `row` (doc_id; with documents=True all columns), n_words,
    n_removed, and kept_sha256 (of the kept words, joined by a space) or, with documents=True,
    kept_text (the text with those words cut out and its spacing kept). `bits` of a word's hash are
    used: with fewer more unequal words meet, and the result stays the same.
    """
    if not 1 <= edge <= window:
        raise ValueError("an edge is from 1 to `window` words long")
    tables = Tables(spark, "repeats")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), ended_bytes(F.col("text")).alias("bytes"))
    known = keyed.where("doc_id is not null")
    kinds = "key long, doc_id long, text_key long, pos int, after long, before long"
    edges = tables.put("edges", known.mapInArrow(_edge_rows(window, edge, bits), kinds))
    paths = tables.put("paths", compacted(edges))
    rows = _judged(tables, known, edges, paths, window, edge, bits)
    tables.drop("edges", "paths")
    loose = rows.where("digest is not null")
    least = tables.put("least", loose.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"))
    again = loose.join(least, "digest").where("doc_id > least")
    spans = (
        rows.where("words is not null and s_doc < doc_id").select("doc_id", "text_key", "start", "stop")
        .unionByName(again.select("doc_id", "text_key", "start", "stop"))
        .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    nothing = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    row = F.struct(*([F.col(f"`{c}`") for c in docs.columns] if documents else ["doc_id"])).alias("row")
    texts = docs.select(row, F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), ended_bytes(F.col("text")).alias("bytes"))
    joined = texts.join(spans, ["doc_id", "text_key"], "left").select("row", "bytes", F.coalesce("spans", nothing).alias("spans"))
    kind = texts.select("row").schema[0].dataType.simpleString()
    last = "kept_text string" if documents else "kept_sha256 string"
    return joined.mapInArrow(_removals(documents), f"row {kind}, n_words long, n_removed long, {last}")


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with repeated spans cut out of `text`; n_chars, where it is there, follows.

    A document that loses words keeps its other columns; one that loses all its words is left out,
    as is one that had none.
    """
    kept = remove_repeats(spark, docs, documents=True).where("n_removed < n_words")
    cut = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.when(cut, F.col("kept_text")).otherwise(column)
        elif c == "n_chars":
            column = F.when(cut, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return kept.select(*columns)
