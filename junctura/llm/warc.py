"""WARC with a Merkle fixity audit: replicas of an archive are compared from their roots down.

Pages become WARC/1.0 resource records, dealt to files by a hash, each with its offset in its
file; WARC files are read by read_warc() and inventory(). A leaf hashes all bytes of a record (SHA-256). Above the leaves, trees go by ordered offset ranges: RANGE bytes
at the lowest level, FANOUT times as many at each further one, and the whole file at the top; a
node hashes its children's places and hashes in order of offset. Two replicas are compared by file roots, and
only the children of nodes that differ are looked at on the next level, down to the records of ranges that differ. These are compared by
their record ids (and, where one repeats in a file, in order of offset), since a lost record moves those behind it.
Node tables have no page contents. A node has as many children as its range
has records, or FANOUT, so no group grows with the archive.

Defined cases: a null url or page is an empty one; repeated rows are records of their own, in one file if they have the same page_id; empty archives have
no nodes and no damage; extra columns are ignored. Damaged files are read on from the next record or gzip member, and what lies between is a row of type "damage".
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import Tables

FILE_BYTES, RANGE, FANOUT, LEVELS = 4 << 20, 64 << 10, 16, 2
_DATE = "2000-01-01T00:00:00Z"


def identity(url: Column, body: Column) -> Column:
    """A record id that follows from a page."""
    digest = F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))).cast("binary"))
    return F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def record(url: Column, body: Column, record_id: Column | None = None) -> Column:
    """The bytes of a resource record, as a string (they are UTF-8)."""
    record_id = identity(url, body) if record_id is None else record_id
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), record_id,
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, tables: Tables, name: str = "records", record_id: Column | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, record_id, file, record_offset, record_length and record_sha256 of each page's record.

    `record_id` (a column) stands for identity(), as in a replica whose pages are damaged.
    """
    record_id = identity(F.col("url"), F.col("html")) if record_id is None else record_id
    body = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record_id.alias("record_id"), record(F.col("url"), F.col("html"), record_id).alias("record"))
    h = F.conv(F.substring(F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), "url").cast("binary")), 1, 8), 16, 10).cast("long")
    leaves = tables.put(name, body.select("page_id", "url", "record_id", h.alias("h"), F.octet_length("record").cast("long").alias("record_length"), F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256")))
    total = leaves.agg(F.coalesce(F.sum("record_length"), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    order = Window.partitionBy("file").orderBy(F.asc_nulls_first("page_id"), "url", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    dealt = leaves.withColumn("file", F.col("h") % files)
    offset = F.coalesce(F.sum("record_length").over(order), F.lit(0))
    return dealt.select("page_id", "record_id", "file", offset.alias("record_offset"), "record_length", "record_sha256")


def _node(rows: DataFrame, keys: list[str], place: str, digest: str) -> DataFrame:
    """One row per node: the hash of its children's places and hashes, in order."""
    children = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(digest).alias("digest"))))
    joined = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["place"].cast("string"), x["digest"])), "\n")
    return rows.groupBy(*keys).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))


def tree(tables: Tables, name: str, records: DataFrame) -> list[DataFrame]:
    """Node tables from the file roots (node 0) down to the lowest ranges: file, node, digest."""
    low = records.withColumn("node", F.floor(F.col("record_offset") / RANGE).cast("long")).withColumn("leaf", F.concat_ws("/", "record_length", "record_sha256"))
    levels = [tables.put(f"{name}0", _node(low, ["file", "node"], "record_offset", "leaf"))]
    for level in range(1, LEVELS + 1):
        above = levels[-1].withColumn("up", F.floor(F.col("node") / FANOUT).cast("long") if level < LEVELS else F.lit(0).cast("long"))
        levels.append(tables.put(f"{name}{level}", _node(above, ["file", "up"], "node", "digest").withColumnRenamed("up", "node")))
    return levels[::-1]


def audit(spark: SparkSession, primary: DataFrame, replica: DataFrame, tables: Tables | None = None) -> DataFrame:
    """file, record_offset and status (altered, lost or extra) of every record in which the replica differs.

    Both have file, record_id, record_offset, record_length and record_sha256; an altered one has another
    length or hash under its id, a lost one is not in the replica, an extra one only there.
    """
    tables = tables or Tables(spark, "audit")
    ours, theirs = tree(tables, "ours", primary), tree(tables, "theirs", replica)
    keys, wrong = ["file", "node"], None
    for level, (a, b) in enumerate(zip(ours, theirs, strict=True)):
        if wrong is not None:
            # Below a root lie all nodes of its file; below any other node those of its range.
            to = F.lit(0).cast("long") if level == 1 else F.floor(F.col("node") / FANOUT).cast("long")
            down = wrong.withColumnRenamed("node", "up")
            a, b = (x.withColumn("up", to).join(down, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        pairs = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), keys, "full")
        wrong = tables.put(f"wrong{level}", pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys))

    def leaves(records: DataFrame, name: str) -> DataFrame:
        node = F.floor(F.col("record_offset") / RANGE).cast("long")
        found = records.withColumn("node", node).join(wrong, keys, "left_semi")
        nth = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("record_offset"))
        return found.select("file", "record_id", nth.alias("nth"), F.struct("record_offset", F.concat_ws("/", "record_length", "record_sha256").alias("leaf")).alias(name))

    pairs = leaves(primary, "a").join(leaves(replica, "b"), ["file", "record_id", "nth"], "full").where(~F.col("a.leaf").eqNullSafe(F.col("b.leaf")))
    status = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "extra").otherwise("altered")
    return pairs.select("file", F.coalesce("a.record_offset", "b.record_offset").alias("record_offset"), status.alias("status"))


def checked(spark: SparkSession, primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of the primary with its status: intact, altered or lost."""
    tables = Tables(spark, "audit")
    found = tables.put("found", audit(spark, primary, replica, tables))
    joined = primary.join(found.where("status <> 'extra'"), ["file", "record_offset"], "left")
    return joined.select("page_id", "file", "record_offset", "record_length", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


#: A record's first line, and the bytes within which its header must end; one that does not is damage.
_FIRST, HEADER_BYTES, PIECE_BYTES = re.compile(rb"WARC/1\.[01]\r\n"), 64 << 10, 16 << 10
_RECORD = "path string, record_id string, record_offset long, record_length long, record_sha256 string, type string, uri string, body binary"


def unpacked(data: bytes) -> bytes:
    """A file's bytes; gzip members are unpacked one by one, and a damaged one is left out from its damage on."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member, end = zlib.decompressobj(31), at
        try:
            while not member.eof and end < len(data):
                out.append(member.decompress(view[end : end + PIECE_BYTES]))
                end = min(len(data), end + PIECE_BYTES)
            end -= len(member.unused_data)
        except zlib.error:
            end = data.find(b"\x1f\x8b\x08", at + 1)
        at = end if end > at else len(data)
    return b"".join(out)


class _Marks:
    """Ascending places of a mark in a file, of which those asked for only go up."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.place = data, mark, -1

    def after(self, at: int) -> int:
        """The first place from `at` on; the end of the file if there is none."""
        if self.place < at:
            found = self.data.find(self.mark, at)
            self.place = found if found >= 0 else len(self.data)
        return self.place


def parsed(data: bytes) -> Iterator[tuple[str, int, int, str, str, str, bytes]]:
    """(record id, offset, length, SHA-256, type, target URI, body) of each record of a WARC file's unpacked bytes.

    Bytes that are no record are one of type "damage", up to the next first line of a record; of several such
    lines before an empty one the last counts, since a header has one. So a header is read once, and the file
    in time in proportion to its length.
    """
    at, blanks = 0, _Marks(data, b"\r\n\r\n")
    firsts = [m.start() for m in _FIRST.finditer(data)]
    while at < len(data):
        end, blank = -1, blanks.after(at)
        if _FIRST.match(data, at) and blank < min(len(data), at + HEADER_BYTES):
            lines = data[at:blank].split(b"\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
            size = fields.get(b"content-length", b"0")
            if re.fullmatch(rb"\d{1,15}", size) and data[(end := blank + 4 + int(size)) : end + 4] != b"\r\n\r\n":
                end = -1
        if end >= 0:
            text = lambda k: fields.get(k, b"").decode("utf-8", "replace")
            yield text(b"warc-record-id"), at, end + 4 - at, hashlib.sha256(data[at : end + 4]).hexdigest(), text(b"warc-type"), text(b"warc-target-uri"), data[blank + 4 : end]
            at = end + 4
            continue
        n, end = bisect_right(firsts, at), len(data)
        if n < len(firsts):
            end = firsts[bisect_left(firsts, blanks.after(firsts[n])) - 1]
        yield "", at, end - at, hashlib.sha256(data[at:end]).hexdigest(), "damage", "", data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, record_id, record_offset, record_length, record_sha256, type, uri and body of the records of WARC files (a task reads a file, and yields it in parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in _RECORD.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for found in parsed(unpacked(content.as_py())):
                    rows.append((name, *found))
                    held += found[2]
                    if held >= FILE_BYTES:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORD)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """What audit() takes, of the WARC files in a folder; `file` is a file's name."""
    return read_warc(spark, path).select(F.substring_index("path", "/", -1).alias("file"), "record_id", "record_offset", "record_length", "record_sha256")
