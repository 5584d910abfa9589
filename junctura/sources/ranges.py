"""Files as byte ranges: lists files by Spark's file systems, and opens a range's file in a task."""

from __future__ import annotations

from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition


@dataclass
class ByteRange(InputPartition):
    """Bytes first:end of the file `path`, which is number `file` of those read; `number` counts the file's ranges."""

    path: str
    file: int
    number: int
    first: int
    end: int


def files(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that paths (files, folders or patterns) name, in order of the paths and then of names."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(conf).globStatus(at)
        listed = []
        for status in found or []:
            inside = at.getFileSystem(conf).listStatus(status.getPath()) if status.isDirectory() else [status]
            listed += [(s.getPath().toString(), s.getLen()) for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
        if not listed:
            raise FileNotFoundError(path)
        out += sorted(listed)
    return out


def split(listed: list[tuple[str, int]], size: int) -> list[ByteRange]:
    """All files cut into ranges of `size` bytes; a compressed file is one range, since it can only be read from its start."""
    out = []
    for file, (path, length) in enumerate(listed):
        step = max(1, length) if path.endswith(".gz") else size
        out += [ByteRange(path, file, n, at, min(length, at + step)) for n, at in enumerate(range(0, max(1, length), step))]
    return out


def local(path: str) -> str | None:
    """The path that open() takes, of one without a scheme or with file:; else None."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def opened(path: str) -> BinaryIO:
    """A file for reading from any place; what is not local goes through Arrow's file systems."""
    if (own := local(path)) is not None:
        return open(own, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)
