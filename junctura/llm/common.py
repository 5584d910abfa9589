"""What the operators of this subpackage share: the shared folder, and words as numpy arrays.

A word is a longest run of characters outside {space, \\t, \\n, \\v, \\f, \\r}. Those six are
single bytes in UTF-8, so words can be cut from the bytes of a text without decoding it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.storage import shared_dir

#: A whitespace character of the word rule, for Java's and DuckDB's regular expressions.
SPACE = r"[ \t-\r]"
#: Bytes of text that the numpy kernels take at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows (texts among them) that a Python worker of an intermediate table is sent at a time.
ARROW_ROWS = 1024
#: Rows of some numbers each (a few MB) up to which a table is sent to all executors.
BROADCAST_ROWS = 1 << 17

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


class Tables:
    """Intermediate tables, written to the shared folder so that a lost executor costs one task.

    A table's plan is cut where it is written; drop() deletes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path, conf, key = f"{self.top}/{name}", self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            at = path(f"{self.top}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(keys: DataFrame) -> DataFrame:
    """The table (a written one), marked for a broadcast join if it has at most BROADCAST_ROWS rows; else joins shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def numbered(tables: Tables, name: str, rows: DataFrame, order: list, column: str) -> DataFrame:
    """Adds `column`, the row's place from 0 under `order`: by range partitions, which are written and counted."""
    n = max(1, int(tables.spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = tables.put(name, ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # a partition's rows are numbered from its number times 2**33
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    starts = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    placed = written.join(starts, part == F.col("_part"))
    return placed.withColumn(column, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def ended_bytes(text: Column) -> Column:
    """A text's bytes and a line feed, so that no word runs into the next text; null is empty."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary")


def word_array(text: Column) -> Column:
    """The words as an array, by built-in functions (a one-character split needs no regular expression)."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a binary column into (first row, end row, bytes, offsets of the rows in them)."""
    if len(column) == 0:
        return
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (with one more at the end)."""
    inside = np.concatenate(([False], ~_SPACES[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RollingHash:
    """64-bit polynomial hashes of slices of a sequence, all by prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n += n // 4
            for name, x in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n + 1, x, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.slices(self.letters[data], starts, ends)

    def windows(self, words: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of `width` values, by its start."""
        starts = np.arange(max(0, len(words) - width + 1))
        return self.slices(words, starts, starts + width)
