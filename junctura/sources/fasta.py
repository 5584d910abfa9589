"""FASTA by byte ranges: a task reads a range, whatever records begin, end or go on in it.

A range does not know whether it begins within a header line. All that hangs on this is what stands before its first
line end: from there on it is among bases. So a task reads that prefix as bases, marks the pieces that it has of it, and says in a
summary of its range what a range after it begins with. A window over the summaries of a file (a few numbers for each
range) tells how each range began, and running sums give the number of records and letters before it. A header that a range's
end cuts is read to the end of its line by the range that it opens in.

The result is a table of pieces, not of sequences: seq_id, file, header, start (of the piece's letters in its record), seq and length
(of the whole record). A record of 250 million letters is some thousand rows from as many tasks as it has ranges.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from junctura.functions import dna
from junctura.sources import ranges
from junctura.storage import written

#: Bytes of a range, and letters of a piece at most.
RANGE, PIECE = 32 << 20, 1 << 16
#: Records (a row of some numbers each) up to which their table is sent to all tasks.
BROADCAST_RECORDS = 1 << 17

_SPACES = b" \t\n\r\v\f"
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))
_VALID = dna.VALID.encode()

#: Rows are pieces (of the prefix or the body) or a range's summary (no letters), whose numbers are of its prefix (p_) and of its body (b_).
_ROWS = pa.schema([
    ("file", pa.int32()), ("number", pa.int64()), ("body", pa.bool_()), ("record", pa.int64()), ("start", pa.int64()), ("header", pa.string()), ("letters", pa.string()),
    ("within", pa.string()), ("p_records", pa.int64()), ("p_letters", pa.int64()), ("p_tail", pa.int64()), ("b_records", pa.int64()), ("b_letters", pa.int64()), ("b_tail", pa.int64()),
])
_DDL = "file int, number long, body boolean, record long, start long, header string, letters string, within string, p_records long, p_letters long, p_tail long, b_records long, b_letters long, b_tail long"


class _Scan:
    """Pieces of a part of a range that begins among bases, and its counts."""

    def __init__(self, where: tuple[int, int, bool], rest):
        self.where, self.rest = where, rest
        self.records = self.letters = self.tail = 0
        self.in_header = False

    def _bases(self, data: bytes, header: str | None) -> Iterator[tuple]:
        letters = data.translate(_UPPER, _SPACES)
        # What stands in a prefix may be the end of a header line; it is checked when that is known.
        if self.where[2] and letters.translate(None, _VALID):
            raise ValueError(f"invalid letter {letters.translate(None, _VALID)[:1]!r} in the record {header or ''}, file {self.where[0]}, range {self.where[1]}")
        for at in range(0, max(len(letters), header is not None), PIECE):
            yield (*self.where, self.records, self.tail + at, header if at == 0 else None, letters[at : at + PIECE].decode("latin-1"))
        self.letters += len(letters)
        self.tail += len(letters)

    def pieces(self, data: bytes) -> Iterator[tuple]:
        at = data.find(b">")
        yield from self._bases(data[: at if at >= 0 else len(data)], None)
        while at >= 0:
            line = data.find(b"\n", at)
            head = data[at + 1 : line] if line >= 0 else data[at + 1 :] + self.rest()
            self.in_header = line < 0
            self.records, self.tail = self.records + 1, 0
            name = head.split(None, 1)[0].decode("utf-8", "replace") if head.strip() else ""
            after = data.find(b">", line) if line >= 0 else -1
            body = b"" if line < 0 else data[line + 1 : after if after >= 0 else len(data)]
            yield from self._bases(body, name)
            at = after


def _scanned(file: int, number: int, data: bytes, rest, known: bool) -> Iterator[tuple]:
    """The rows of a range; `known` if it begins among bases, else its first line is a prefix. rest() reads on to the end of a line."""
    line = -1 if known else data.find(b"\n")
    alone = not known and line < 0
    prefix, body = _Scan((file, number, False), rest), _Scan((file, number, True), rest)
    yield from prefix.pieces(b"" if known else data if alone else data[: line + 1])
    if not alone:
        yield from body.pieces(data[line + 1 :])
        within = "header" if body.in_header else "bases"
    else:  # one line: it is a header at its end if one opens in it, else it is what it was before
        within = "header" if prefix.records else None
    yield (file, number, None, None, None, None, None, within, prefix.records, prefix.letters, prefix.tail, body.records, body.letters, body.tail)


def _blocks(part: ranges.ByteRange, size: int) -> Iterator[tuple]:
    if part.path.endswith(".gz"):
        with ranges.opened(part.path) as raw, gzip.GzipFile(fileobj=raw) as file:
            number = 0
            while block := file.read(size):  # each block ends with a line, so all begin among bases
                yield from _scanned(part.file, number, block + file.readline(), lambda: b"", True)
                number += 1
            if not number:
                yield from _scanned(part.file, 0, b"", lambda: b"", True)
        return
    with ranges.opened(part.path) as file:
        file.seek(part.first)
        data = file.read(part.end - part.first)

        def rest() -> bytes:
            file.seek(part.end)
            out = b""
            while (more := file.read(1 << 12)) and b"\n" not in more:
                out += more
            return out + more.partition(b"\n")[0]

        yield from _scanned(part.file, part.number, data, rest, part.number == 0)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.size = json.loads(options["files"]), int(options["range"])

    def partitions(self) -> list[ranges.ByteRange]:
        return ranges.split(self.files, self.size)

    def read(self, partition: ranges.ByteRange) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)
        for row in _blocks(partition, self.size):
            held.append((*row, *[None] * (len(_ROWS) - len(row))))
            letters += len(row[6] or "")
            if letters >= 1 << 22 or len(held) >= 1 << 14:
                yield table()
                held, letters = [], 0
        if held:
            yield table()


class FastaRanges(DataSource):
    """Pieces and summaries of the byte ranges of files; read_fasta() makes sequences of them."""

    @classmethod
    def name(cls) -> str:
        return "junctura-fasta"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _placed(summaries: DataFrame) -> DataFrame:
    """Each range with how it began (`bases`), the records before it in its file, the letters of the record that goes on in it, and its records."""
    order = Window.partitionBy("file").orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    began = summaries.withColumn("bases", F.coalesce(F.last("within", ignorenulls=True).over(before), F.lit("bases")) == "bases")
    own = lambda c: F.when(F.col("bases"), F.col(c)).otherwise(F.lit(0))
    tail = F.when(F.col("b_records") > 0, F.col("b_tail")).otherwise(own("p_tail") + F.col("b_letters"))
    counted = began.withColumns({"records": own("p_records") + F.col("b_records"), "letters": own("p_letters") + F.col("b_letters"), "tail": tail})
    counted = counted.withColumn("letters_before", F.coalesce(F.sum("letters").over(before), F.lit(0)))
    opened = F.when(F.col("records") > 0, F.col("letters_before") + F.col("letters") - F.col("tail"))
    counted = counted.withColumn("opened", opened).withColumn("carried", F.col("letters_before") - F.coalesce(F.max("opened").over(before), F.lit(0)))
    return counted.withColumn("records_before", F.coalesce(F.sum("records").over(before), F.lit(0)))


def read_fasta(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """seq_id, file, header, start, seq and length of the pieces of all records of FASTA files (.gz too, a task each).

    seq_id counts the records in order of the paths and within each file. A record opens with ">" at any place but a header line; its
    header is the first word of that line ('' if there is none); white space among bases is skipped, letters are upper-cased. Any
    other than a valid letter, or letters before the first record, are an error. A record without letters is one empty piece.
    """
    listed = ranges.files(spark, *paths)
    spark.dataSource.register(FastaRanges)
    rows = written(spark.read.format(FastaRanges.name()).option("files", json.dumps(listed)).option("range", str(range_bytes)).load(), "fasta")
    placed = written(_placed(rows.where("within is not null or p_records is not null").drop("body", "record", "start", "header", "letters")), "fasta-ranges")
    # A row per file, then per range.
    sums = placed.groupBy("file").agg(F.sum("records").alias("n"))
    firsts = sums.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = placed.join(F.broadcast(firsts), "file").select("file", "number", "bases", "p_records", "p_letters", "p_tail", "carried", (F.col("first") + F.col("records_before")).alias("before"), "first")
    pieces = rows.where("letters is not null").select("file", "number", "body", "record", "start", "header", "letters")
    joined = pieces.join(placed, ["file", "number"]).where(F.col("body") | F.col("bases"))
    in_prefix = F.when(F.col("bases"), F.col("p_records")).otherwise(F.lit(0))
    record = F.col("before") + F.col("record") + F.when(F.col("body"), in_prefix).otherwise(F.lit(0))
    went_on = F.when(F.col("body") & F.col("bases") & (F.col("p_records") > 0), F.col("p_tail")).when(F.col("body") & F.col("bases"), F.col("carried") + F.col("p_letters")).otherwise(F.col("carried"))
    start = F.col("start") + F.when(F.col("record") == 0, went_on).otherwise(F.lit(0))
    bad = F.raise_error(F.lit("a FASTA record opens with '>'")).cast("long")
    wrong = F.raise_error(F.lit("invalid letter in a FASTA record"))
    letters = F.when(F.col("body") | dna.is_valid(F.col("letters")), F.col("letters")).otherwise(wrong.cast("string"))
    own = joined.select("file", F.when(record > F.col("first"), record - 1).otherwise(bad).alias("seq_id"), start.alias("start"), "header", letters.alias("seq"))
    records = written(own.groupBy("seq_id").agg(F.max("header").alias("header"), F.sum(F.length("seq")).cast("long").alias("length")), "fasta-records")
    named = F.broadcast(records) if records.count() <= BROADCAST_RECORDS else records
    names = spark.createDataFrame([(n, path.rsplit("/", 1)[-1]) for n, (path, _) in enumerate(listed)], "n int, name string")
    # A header at the end of its range has an empty piece, which stays only if the record has no letters at all.
    found = own.drop("header").join(named, "seq_id").where((F.length("seq") > 0) | (F.col("length") == 0)).join(F.broadcast(names), F.col("file") == F.col("n"))
    return found.select("seq_id", F.col("name").alias("file"), "header", "start", "seq", "length")


def whole(pieces: DataFrame) -> DataFrame:
    """One row for each record, for sequences that fit one: seq_id, header, seq and length (and file)."""
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    columns = [c for c in pieces.columns if c not in ("start", "seq")]
    return pieces.groupBy(*columns).agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
