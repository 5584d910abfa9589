"""The binary junction file: 12-byte records (uint32 position, int64 id), and separators between sequences.

It is read by ranges of records and written by offsets. A separator opens the next sequence; a range counts its own, and
sums over ranges tell how many stand before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from junctura.operators.ranking import starts
from junctura.sources import positional, ranges

# The record's layout, and the record that opens the next sequence.
RECORD = np.dtype([("pos", "<u4"), ("id", "<i8")])
SEPARATOR_POS, SEPARATOR_ID = 4294967295, 9223372036854775807
#: Records of a range, and of a batch of it.
RANGE, BATCH = 1 << 21, 1 << 16


def with_separators(positions: DataFrame) -> DataFrame:
    """seq_id, at (their order), pos and junction_id of the file's records: a separator stands before each sequence's place but the first's.

    The last separator opens the last sequence that has records.
    """
    last = positions.agg(F.max("seq_id")).first()[0] or 0
    separators = positions.sparkSession.range(1, last + 1).select(F.col("id").alias("seq_id"), F.lit(-1).cast("long").alias("at"), F.lit(SEPARATOR_POS).alias("pos"), F.lit(SEPARATOR_ID).alias("junction_id"))
    return separators.unionByName(positions.select("seq_id", F.col("pos").cast("long").alias("at"), F.col("pos").cast("long"), F.col("junction_id").cast("long")))


def _records(batch: pa.RecordBatch) -> bytes:
    out = np.empty(batch.num_rows, RECORD)
    out["pos"], out["id"] = batch.column("pos").to_numpy(), batch.column("junction_id").to_numpy()
    return out.tobytes()


def write(positions: DataFrame, path: str) -> int:
    """One file in the records' order, written by all tasks at their offsets; returns its bytes."""
    return positional.write(with_separators(positions), ["seq_id", "at"], _records, path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.size = json.loads(options["files"]), int(options["range"])

    def partitions(self) -> list[ranges.ByteRange]:
        if any(length % RECORD.itemsize for _, length in self.files):
            raise ValueError("a junction file has whole records")
        found = ranges.split(self.files, self.size * RECORD.itemsize)
        for n, part in enumerate(found):
            part.number = n  # blocks are counted over all files
        return found

    def read(self, partition: ranges.ByteRange) -> Iterator[pa.RecordBatch]:
        step, names = 0, ["block", "step", "pos", "junction_id"]
        with ranges.opened(partition.path) as file:
            file.seek(partition.first)
            for at in range(partition.first, partition.end, BATCH * RECORD.itemsize):
                found = np.frombuffer(file.read(min(BATCH * RECORD.itemsize, partition.end - at)), RECORD)
                separator = (found["pos"] == SEPARATOR_POS) & (found["id"] == SEPARATOR_ID)
                steps, kept = step + np.cumsum(separator), ~separator
                step += int(separator.sum())
                rows = [np.full(kept.sum(), partition.number), steps[kept], found["pos"][kept].astype(np.int64), found["id"][kept]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (partition.number, step, None, None)], names)


class JunctionRanges(DataSource):
    """block, step (separators up to the record in its block), pos and junction_id; without pos, a block's number of separators."""

    @classmethod
    def name(cls) -> str:
        return "junctura-junctions"

    def schema(self) -> str:
        return "block long, step long, pos long, junction_id long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, *paths: str, range_records: int = RANGE) -> DataFrame:
    """seq_id, pos and junction_id of a junction file; several files (or a folder's, by name) are one that goes on."""
    spark.dataSource.register(JunctionRanges)
    rows = spark.read.format(JunctionRanges.name()).option("files", json.dumps(ranges.files(spark, *paths))).option("range", str(range_records)).load()
    counts = rows.where("pos is null").select(F.col("block").alias("_block"), F.col("step").alias("_n"))
    placed = rows.where("pos is not null").join(starts(counts, "_block", "_n", "_start"), F.col("block") == F.col("_block"))
    return placed.select((F.col("_start") + F.col("step")).cast("long").alias("seq_id"), "pos", "junction_id")


def marks(positions: DataFrame, sequences: DataFrame) -> DataFrame:
    """seq_id, length and the sorted positions that are marked in each sequence (none: an empty array)."""
    found = positions.groupBy("seq_id").agg(F.sort_array(F.collect_set("pos")).alias("marks"))
    none = F.array().cast("array<long>")
    own = sequences.where("start = 0") if "start" in sequences.columns else sequences
    return own.select("seq_id", "length").join(found, "seq_id", "left").select("seq_id", "length", F.coalesce("marks", none).alias("marks"))
