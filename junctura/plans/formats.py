"""Text of the graph: tables of lines with a key that gives their order.

A line may be put together of several rows, so that none grows with a sequence or with the places of a junction: all but its last row are `open`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators import segments
from junctura.operators.packed import text_bytes
from junctura.operators.ranking import ranked

TAB = "\t"
#: Places of a junction in a row of its line, as a power of two.
RUN_BITS = 12


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def sign(c: Column) -> Column:
    return F.when(c >= 0, F.lit("+")).otherwise(F.lit("-"))


def oriented(c: Column) -> Column:
    return F.concat(F.abs(c).cast("string"), sign(c))


def position(at: Column, length: Column) -> Column:
    """A position of GFA2, with $ at the end of what it lies in."""
    return F.concat(at.cast("string"), F.when(at == length, F.lit("$")).otherwise(F.lit("")))


def seq_lines(positions: DataFrame) -> DataFrame:
    return positions.select("seq_id", "pos", F.concat_ws(" ", _str("seq_id"), _str("pos"), _str("junction_id")).alias("line"))


def group_pieces(positions: DataFrame) -> DataFrame:
    """Rows (seq_id and pos of the id's first place, n, line, open) of a line per signed id, with all its places in order.

    Places are ranked over the whole table by id, so runs of ranks hold a bounded number of them, however many an id has.
    """
    placed = ranked(positions.select("junction_id", "seq_id", "pos"), ["junction_id", "seq_id", "pos"], "rank", 0)
    places = F.array_sort(F.collect_list(F.struct("seq_id", "pos")))
    runs = placed.groupBy("junction_id", F.shiftright("rank", RUN_BITS).alias("n")).agg(places.alias("places"))
    text = F.array_join(F.transform("places", lambda x: F.concat_ws(" ", x["seq_id"].cast("string"), x["pos"].cast("string"))), "; ")
    first = F.get("places", F.lit(0))
    runs = runs.select("junction_id", "n", F.concat(text, F.lit("; ")).alias("line"), first.alias("first"))
    order = Window.partitionBy("junction_id")
    known = runs.withColumns({"begin": F.min("first").over(order), "last": F.max("n").over(order)})
    return known.select(F.col("begin.seq_id").alias("seq_id"), F.col("begin.pos").alias("pos"), "n", "line", (F.col("n") < F.col("last")).alias("open"))


def joined_lines(pieces: DataFrame, *keys: str) -> DataFrame:
    """The whole lines of rows that make up lines, named by `keys`."""
    parts = F.array_sort(F.collect_list(F.struct("n", "line")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "").alias("line"))


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line per id of places in order of (id, seq_id, pos): what a batch has of its last line goes on in the next batch, and is held as the line's bytes alone."""

    def lines(first: pa.RecordBatch, ends: np.ndarray, letters: np.ndarray | bytearray) -> pa.RecordBatch:
        line = pa.StringArray.from_buffers(first.num_rows, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))
        return pa.RecordBatch.from_arrays([first.column("seq_id"), first.column("pos"), line], ["seq_id", "pos", "line"])

    def ended() -> pa.RecordBatch:
        if len(held) > np.iinfo(np.int32).max:
            raise ValueError("a line is too long for a row; write a file, where a line may be several rows")
        return lines(first, np.array([0, len(held)]), held)

    first, held = None, bytearray()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.binary_join_element_wise(*[pc.cast(batch.column(c), pa.string()) for c in ("seq_id", "pos")], " ")
        letters, bounds = text_bytes(pc.binary_join_element_wise(text, "", "; "))
        new = np.flatnonzero(np.diff(ids := batch.column("junction_id").to_numpy(), prepend=~ids[:1]))
        ends = bounds[np.append(new, len(ids))]
        if first is not None and first.column("junction_id")[0].as_py() == ids[0]:
            held += letters[: ends[1]].data
            new, ends = new[1:], ends[1:]
        if not len(new):
            continue
        if first is not None:
            yield ended()
        if len(new) > 1:
            yield lines(batch.take(pa.array(new[:-1])), ends[:-1] - ends[0], letters[ends[0] : ends[-2]])
        first, held = batch.take(pa.array(new[-1:])), bytearray(letters[ends[-2] : ends[-1]].data)
    if first is not None:
        yield ended()


def _near() -> Column:
    """One number that never falls in order of (junction_id, seq_id): ordered by it first, few rows are compared by all their columns."""
    number, low = F.col("junction_id"), F.least(F.greatest("seq_id", F.lit(0)), F.lit((1 << 32) - 1))
    beyond = F.when(number > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return F.when(F.abs(number) < 1 << 31, F.shiftleft(number, 32) + low).otherwise(beyond)


def group_lines(places: DataFrame, dealt: bool = False) -> DataFrame:
    """A line per signed id, all its places, ordered by the first; seq_id and pos are those of the first.

    Whole lines hold all places of an id, so one shuffle brings them together (`dealt`: it has, as packed.dealt() does); files take group_pieces().
    Places are ordered by Spark's sort, which spills, and a task holds one line's text at a time, not its places.
    """
    rows = places.select("junction_id", "seq_id", "pos")
    rows = rows if dealt else rows.repartition("junction_id")
    return rows.sortWithinPartitions(_near(), "junction_id", "seq_id", "pos").mapInArrow(_whole_lines, "seq_id long, pos long, line string")


def dot_lines(pairs: DataFrame) -> DataFrame:
    label = _text('label="chr=', _str("seq_id"), " pos=", _str("begin"), '"]')
    blue = _text(TAB, _str("b"), " -> ", _str("e"), '[color="blue", ', label)
    red = _text(TAB, _str(-F.col("e")), " -> ", _str(-F.col("b")), '[color="red", ', label)
    rows = F.array(F.struct(F.lit(0).alias("n"), blue.alias("line")), F.struct(F.lit(1).alias("n"), red.alias("line")))
    return pairs.select("seq_id", F.col("begin").alias("pos"), F.explode(rows).alias("x")).select("seq_id", "pos", "x.n", "x.line")


def gfa1_inputs(names: DataFrame) -> DataFrame:
    return names.select("seq_id", _text("S\t", F.col("name"), "\t*\tUR:Z:", F.col("file")).alias("line"))


def segment_lines(bodies: DataFrame, version: int) -> DataFrame:
    size = [_str("size"), TAB] if version == 2 else []
    return bodies.select("seq_id", F.col("begin").alias("pos"), _text("S\t", _str(F.abs("segment_id")), TAB, *size, F.col("body")).alias("line"))


def occurrence_lines(found: DataFrame, k: int, version: int) -> DataFrame:
    """A line for each segment of runs with names and lengths (JunctionGraph.labelled())."""
    joined = segments.pieces(found, "name", "length")
    own = F.col("segment_id")
    if version == 1:
        line = _text("C\t", _str(F.abs(own)), TAB, sign(own), TAB, F.col("name"), "\t+\t", _str("end"))
    else:
        last = F.col("end") + k
        line = _text("F\t", _str(F.abs(own)), TAB, F.col("name"), sign(own), "\t0\t", _str(last - F.col("begin")), "$\t", position(F.col("begin"), F.col("length")), TAB, position(last, F.col("length")), f"\t{k}M")
    return joined.select("seq_id", F.col("begin").alias("pos"), line.alias("line"))


def link_lines(links: DataFrame, k: int, version: int) -> DataFrame:
    a, b, n, m = F.col("a"), F.col("b"), F.col("a_size"), F.col("b_size")
    if version == 1:
        line = _text("L\t", _str(F.abs(a)), TAB, sign(a), TAB, _str(F.abs(b)), TAB, sign(b), f"\t{k}M")
    else:
        ends = [F.when(a > 0, n - k).otherwise(F.lit(0)), F.when(a > 0, n).otherwise(F.lit(k)), F.when(b > 0, F.lit(0)).otherwise(m - k), F.when(b > 0, F.lit(k)).otherwise(m)]
        line = _text("E\t", oriented(a), TAB, oriented(b), TAB, F.concat_ws(TAB, *[position(x, size) for x, size in zip(ends, (n, n, m, m), strict=True)]), f"\t{k}M")
    return links.select("seq_id", F.col("begin").alias("pos"), line.alias("line"))


def path_pieces(paths: DataFrame, names: DataFrame, version: int) -> DataFrame:
    """Rows (seq_id, n, line, open) of each sequence's path, one for each of its parts."""
    order = Window.partitionBy("seq_id")
    joined = paths.join(names.select("seq_id", "name"), "seq_id").withColumns({"low": F.min("part").over(order), "high": F.max("part").over(order)})
    first, last, between = F.col("part") == F.col("low"), F.col("part") == F.col("high"), "," if version == 1 else " "
    head = _text("P\t", F.col("name"), TAB) if version == 1 else _text("O\t", F.col("name"), "p\t")
    end = F.lit("\t*" if version == 1 else "")
    line = F.concat(F.when(first, head).otherwise(F.lit(between)), F.array_join(F.transform("path", oriented), between), F.when(last, end).otherwise(F.lit("")))
    return joined.select("seq_id", F.col("part").alias("n"), line.alias("line"), (~last).alias("open"))


def path_lines(paths: DataFrame, names: DataFrame, version: int) -> DataFrame:
    return joined_lines(path_pieces(paths, names, version), "seq_id")


def fasta_lines(bodies: DataFrame, width: int = 80) -> DataFrame:
    """A record per segment, named by its id, wrapped."""
    wrapped = F.regexp_replace("body", f"(.{{{width}}})(?=.)", "$1\n")
    return bodies.select("seq_id", F.col("begin").alias("pos"), _text(">", _str(F.abs("segment_id")), "\n", wrapped).alias("line"))
