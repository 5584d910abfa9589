"""One file written by many tasks: rows are encoded range by range, and each block of bytes goes to its offset.

Rows are dealt by ranges of their order and encoded there into blocks, which are written to the shared folder. Sums of
the ranges' bytes say where each begins, so a block has an offset, and tasks write blocks in any order, again if
they are run again. The driver moves no rows: it commits the file under its name. Where files can't be written at
offsets (stores of objects), a folder gets a file for
blocks that follow each other, named by the first one's offset; in order of names they are the same bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from junctura.operators.ranking import ordered, starts
from junctura.sources import ranges
from junctura.storage import written

#: Bytes of a block (tasks get thousands of rows at a time, so these bound their memory), and of a file of blocks where there are no offsets.
BLOCK, FILE = 8 << 10, 4 << 20

Encode = Callable[[pa.RecordBatch], bytes]


def _encoded(encode: Encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, data = batch.column("_part")[0].as_py(), encode(batch)
            for first in range(0, len(data), FILE):
                places = range(first, min(len(data), first + FILE), BLOCK)
                blocks = [data[i : min(i + BLOCK, first + FILE)] for i in places]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array([at + i for i in places], pa.int64()), pa.array(blocks, pa.binary())], ["part", "at", "data"])
            at += len(data)

    return run


@dataclass
class _Written(WriterCommitMessage):
    bytes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options["size"])
        self.local = ranges.local(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        total = 0
        if self.local is not None:
            file = os.open(f"{self.local}.part", os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                for batch in iterator:
                    for offset, data in zip(batch.column("offset"), batch.column("data"), strict=True):
                        offset, view = offset.as_py(), memoryview(data.as_buffer())
                        while view:
                            done = os.pwrite(file, view, offset)
                            view, offset, total = view[done:], offset + done, total + done
                os.fsync(file)
            finally:
                os.close(file)
            return _Written(total)
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        out, first, end = None, 0, -1
        try:
            for batch in iterator:
                for offset, data in zip(batch.column("offset"), batch.column("data"), strict=True):
                    offset, data = offset.as_py(), data.as_buffer()
                    # Blocks that follow each other share a file.
                    if offset != end or end - first >= FILE:
                        if out is not None:
                            out.close()
                        out, first, end = system.open_output_stream(f"{folder}/{offset:020d}"), offset, offset
                    out.write(data)
                    end, total = end + len(data), total + len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(total)

    def commit(self, messages: list) -> None:
        if sum(m.bytes for m in messages if m is not None) != self.size:
            raise OSError(f"{self.path}: not all blocks were written")
        if self.local is not None:
            with open(f"{self.local}.part", "ab"):  # an empty file has no blocks
                pass
            os.truncate(f"{self.local}.part", self.size)
            os.replace(f"{self.local}.part", self.local)

    def abort(self, messages: list) -> None:
        if self.local is not None:
            Path(f"{self.local}.part").unlink(missing_ok=True)


class PositionalFile(DataSource):
    """Writes rows (offset, data) into one file of a given size."""

    @classmethod
    def name(cls) -> str:
        return "junctura-file"

    def schema(self) -> str:
        return "offset long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write(rows: DataFrame, order: list, encode: Encode, path: str) -> int:
    """Writes what `encode` makes of the rows, in their order, to one file; returns its size. A file of that name is replaced."""
    spark = rows.sparkSession
    spark.dataSource.register(PositionalFile)
    blocks = written(ordered(rows, order).withColumn("_part", F.spark_partition_id()).mapInArrow(_encoded(encode), "part int, at long, data binary"), "blocks")
    sizes = blocks.groupBy(F.col("part").alias("_part")).agg(F.sum(F.length("data")).alias("_size"))
    size = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    placed = blocks.join(starts(sizes, "_part", "_size", "_start"), F.col("part") == F.col("_part"))
    placed.select((F.col("_start") + F.col("at")).cast("long").alias("offset"), "data").write.format(PositionalFile.name()).option("path", path).option("size", str(size)).mode("append").save()
    return size


def text_lines(batch: pa.RecordBatch) -> bytes:
    """Lines of text; one with `open` goes on in the next row."""
    ends = batch.column("open").to_pylist() if "open" in batch.schema.names else [False] * batch.num_rows
    return b"".join(line.encode() + (b"" if more else b"\n") for line, more in zip(batch.column("line").to_pylist(), ends, strict=True))
