"""Best-fit packing: pieces of tokenised documents into sequences, by hierarchical residual packing.

Tokenising cuts every document into pieces of at most `capacity` tokens. Packing works on lengths
alone: (1) each partition of the pieces packs its own by best fit, longest first; bins with at most
`slack` places left are emitted; (2) the underfull bins become items, are dealt into groups of about
GROUP items, and each group packs its items by best fit again; what stays underfull goes to the
next round, with fewer groups, until one group has packed the rest or a round merges less than a
hundredth of its bins. Each round is a written table of (bin, parent, place in the parent); a piece finds its
sequence by one join to the composed table. So no task holds more than GROUP items at a time,
and none sees a text but its own.

Token ids are remembered by word, for as long as the Python worker lives: the tokenizer's rules (a Unicode normal form, lower case, a split into letters,
digits and signs, all within white space) make the ids of a text those of its words, one after another. New words are
encoded some thousands in one text. tests/llm compares the ids with the tokenizer's on whole texts.

Defined cases: a null or empty text is its end token alone; rows that repeat a doc_id are packed
each; doc_id may be null. Extra columns are ignored. Ties go to the earlier piece in file order.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import Tables, blocks, ended_bytes

CAPACITY, SLACK = 2048, 4
#: Items (and bytes of them) that one task packs at a time, and words whose ids a worker remembers (about 150 bytes each) during a task and after it.
GROUP, HELD_BYTES, REMEMBERED, KEPT = 100_000, 1 << 27, 1 << 19, 1 << 18


#: A control character; as a word it is one token, which tells where the words of a joined text end.
_BETWEEN = b"\x02"


#: A run of small letters of ASCII or Latin-1: the tokenizer neither changes nor splits it.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Bytes that end words, that such signs may follow, and signs that are split off there (none opens a contraction).
_SPACE, _LETTER, _SIGN = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\v\f\r", b"0123456789abcdefghijklmnopqrstuvwxyz", b".,!?;:%&*$#"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def stems(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """Each text's words, in lower-case ASCII, without a sign that ends them, which is a word of its own.

    The tokenizer ignores case and splits such a sign off itself, so the ids stay the same; but there are fewer
    different words. A letter before a character outside ASCII keeps its case: the tokenizer composes before it
    lower-cases, and some marks compose with the small letter only. Special tokens' names are read as they are: a block that may have one is not changed. Every text
    ends with a space.
    """
    if b"<|" not in data.tobytes():
        data = np.where(np.append(data[1:], 0) < 128, _LOWER[data], data)
        at = np.flatnonzero(_SIGN[data[1:-1]] & _SPACE[data[2:]] & _LETTER[data[:-2]]) + 1
        data, offsets = np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b].split() for a, b in zip(at, at[1:], strict=False)]


class _WordIds(dict):
    """A word's ids as little-endian 32-bit numbers; kept by the worker from task to task."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.between = np.frombuffer(self._alone(_BETWEEN), "<u4")
        self.last = np.zeros(0, bool)  # the ids that end a word, if the vocabulary tells
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def _alone(self, word: bytes) -> bytes:
        return np.array(self._ids(word), "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        return self._alone(word)

    def _put(self, group: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.update(zip(group, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))

    def _learn_runs(self, group: list[bytes]) -> None:
        """Words that are one run of small letters each, so that each ends with an id that ends a word."""
        ids = np.array(self._ids(b" ".join(group)), "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(group):
            self._put(group, ids, np.concatenate(([0], ends[:-1])), ends)
        else:
            self._learn_any(group)

    def _learn_any(self, group: list[bytes]) -> None:
        ids = np.array(self._ids((b" " + _BETWEEN + b" ").join(group)), "<u4")
        ends = np.flatnonzero(ids == self.between[0]) if len(self.between) == 1 else ()
        if len(ends) == len(group) - 1:
            self._put(group, ids, np.concatenate(([0], ends + 1)), np.append(ends, len(ids)))
        else:
            self.update((w, self._alone(w)) for w in group)

    def learn(self, words: set[bytes]) -> None:
        """Encodes the short ones of new words, some thousands in one text."""
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        runs, others = [], []
        for w in words:
            if len(w) <= 64:
                if len(self.last) and _RUN(w):
                    runs.append(w)
                elif _BETWEEN not in w:
                    others.append(w)
        for found, learn in ((runs, self._learn_runs), (others, self._learn_any)):
            for first in range(0, len(found), 4096):
                learn(found[first : first + 4096])

    def trim(self) -> None:
        """Forgets all but the words that were met first, most frequent ones among them: the worker's memory is others' too."""
        if len(self) > KEPT:
            first = list(islice(self.items(), KEPT))
            self.clear()
            self.update(first)

    def texts(self, split: list[list[bytes]]) -> list[bytes]:
        """The ids of each text; what is not known yet is learnt for all of them together."""
        found = [[*map(self.get, words)] for words in split]
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        self.learn({words[i] for words, gap in zip(split, gaps, strict=True) for i in gap})
        for words, ids, gap in zip(split, found, gaps, strict=True):
            for i in gap:
                ids[i] = self[words[i]]
        return [*map(b"".join, found)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = "bin long, bin_offset long, bin_used long"
_known: dict[str, _WordIds] = {}


def _ids(path: str) -> _WordIds:
    if path not in _known:
        _known.clear()
        _known[path] = _WordIds(path)
    return _known[path]


def _cut(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(path)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            texts = batch.column("bytes")
            for first_row, _, data, offsets in blocks(texts):
                for at, ids in enumerate(ids_of.texts(stems(data, offsets)), first_row):
                    ids += end
                    for n, first in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[first : first + 4 * capacity]
                        row.append(at)
                        piece.append(n)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            parts.append(part)
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)
        ids_of.trim()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of at most `capacity` tokens; keep_ids adds the ids.

    `tokenizer` is the path of a tokenizers file that every executor has.
    """
    texts = docs.select(F.col("doc_id").cast("long"), ended_bytes(F.col("text")).alias("bytes"))
    kinds = _PIECE + ", ids binary" * keep_ids
    return texts.mapInArrow(_cut(tokenizer, end_id, capacity, keep_ids), kinds)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset in it) of each item, and what each bin holds."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by the places left
    mask = 0  # which of these lists have a bin
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
            offsets[item] = used[chosen]
            used[chosen] += size
        else:
            chosen, room = len(used), capacity
            used.append(size)
        bins[item] = chosen
        left = room - size
        if left:
            open_bins[left].append(chosen)
            mask |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _local(capacity: int):
    """A partition's pieces with their bins: numbers of the partition, then of its runs of GROUP pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, rows, size = TaskContext.get().partitionId() << 36, [], 0, 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            table = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, used = best_fit(table.column("length").to_numpy(), capacity)
            for name, values in (("bin", first + bins), ("bin_offset", offsets), ("bin_used", used[bins])):
                table = table.append_column(name, pa.array(values, pa.int64()))
            first += len(used)
            return table.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= GROUP or size >= HELD_BYTES:
                yield from packed()
                held, rows, size = [], 0, 0
        if rows:
            yield from packed()

    return run


def _merged(capacity: int, level: int):
    """A group's underfull bins packed into bins of the next level; `parent` is unique by group."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        bins, offsets, used = best_fit(group["used"].to_numpy(), capacity)
        top = ((level + 1) << 58) | (int(key[0]) << 36)
        return pd.DataFrame({"bin": group["bin"], "parent": top + bins, "place": offsets, "used": used[bins]})

    return run


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """The pieces (any columns, `length` among them) with sequence_id and offset."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return _merge(spark, pieces.mapInArrow(_local(capacity), f"{kinds}, {_BIN}"), capacity, slack)


def _merge(spark: SparkSession, local: DataFrame, capacity: int, slack: int) -> DataFrame:
    """Rounds over the underfull bins of locally packed pieces, which are written first: bins are numbered by partition."""
    tables = Tables(spark, "packing")
    columns = [c for c in local.columns if c not in ("bin", "bin_offset", "bin_used")]
    local = tables.put("local", local)
    full = capacity - slack
    items = tables.put("items0", local.where(f"bin_offset = 0 and bin_used < {full}").select("bin", F.col("bin_used").alias("used")))
    n, level, moves = items.count(), 0, None
    while n > 1 and level < 15:
        groups = -(-n // GROUP)
        dealt = items.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
        merged = tables.put(f"merged{level}", dealt.groupBy("group").applyInPandas(_merged(capacity, level), "bin long, parent long, place long, used long"))
        step = merged.select("bin", "parent", "place")
        if moves is None:
            moves = step
        else:
            deeper = step.select(F.col("bin").alias("parent"), F.col("parent").alias("above"), F.col("place").alias("further"))
            moves = moves.join(deeper, "parent", "left").select("bin", F.coalesce("above", "parent").alias("parent"), (F.col("place") + F.coalesce("further", F.lit(0))).alias("place"))
        moves = tables.put(f"moves{level}", moves)
        items = merged.where(f"place = 0 and used < {full}").select(F.col("parent").alias("bin"), "used")
        before, n, level = n, items.count(), level + 1
        if groups == 1 or n > 0.99 * before:
            break
    out = [F.col(f"`{c}`") for c in columns]
    if moves is None:
        return local.select(*out, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    joined = local.join(moves, "bin", "left")
    return joined.select(*out, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("place", F.lit(0))).alias("offset"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, slack: int = SLACK, keep_ids: bool = False) -> DataFrame:
    """Tokenises and packs: the columns of token_pieces() with sequence_id and offset.

    One Python worker of a task tokenises and packs locally.
    """
    cut, local = _cut(tokenizer, end_id, capacity, keep_ids), _local(capacity)
    texts = docs.select(F.col("doc_id").cast("long"), ended_bytes(F.col("text")).alias("bytes"))
    kinds = _PIECE + ", ids binary" * keep_ids
    rows = texts.mapInArrow(lambda batches: local(cut(batches)), f"{kinds}, {_BIN}")
    return _merge(spark, rows, capacity, slack)
