"""Sequences from any table with an id and a text, and what is known of sequences besides their letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators.packed import text_bytes

#: The letters of a text that stay (in either case), and what of them becomes N, which marks what is indefinite.
VARIANTS = {
    "clean": ("ACGT", ""),
    "gapped": ("ACGTKXY", "KXY"),
    "iupac": (dna.VALID, "URYKMSWBDHXV"),
}


def _spelled(variant: str):
    """seq_id, header, seq and length of seq_id and text: a table gives for each byte of a text the letter that it becomes, or 0 if it goes."""
    kept, unknown = VARIANTS[variant]
    table = np.zeros(256, np.uint8)
    for letter in kept:  # all are ASCII, so no byte of another character is one of them
        table[[ord(letter), ord(letter.lower())]] = ord("N" if letter in unknown else letter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_bytes(batch.column("text"))
            letters, some = table[raw], np.flatnonzero(np.diff(bounds))
            stays, counts = letters != 0, np.zeros(batch.num_rows, np.int64)
            if len(some):
                counts[some] = np.add.reduceat(stays, bounds[some], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            seq = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(ends), pa.py_buffer(letters[stays]))
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("header"), seq, pa.array(counts)], ["seq_id", "header", "seq", "length"])

    return run


def from_documents(docs: DataFrame, variant: str = "clean") -> DataFrame:
    """seq_id, header, seq and length of each document, under one of VARIANTS."""
    number = F.col("doc_id").cast("long")
    rows = docs.select(number.alias("seq_id"), F.concat(F.lit("doc"), number.cast("string")).alias("header"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_spelled(variant), "seq_id long, header string, seq string, length long")


def to_fasta(sequences: DataFrame, width: int = 70) -> DataFrame:
    """seq_id and the record's text, wrapped."""
    body = F.regexp_replace("seq", f"(.{{{width}}})", "$1\n")
    return sequences.select("seq_id", F.concat(F.lit(">"), "header", F.lit("\n"), body).alias("fasta"))


def name(prefix: bool = False) -> Column:
    """The header, with `prefix` s<seq_id>_ before it."""
    return F.concat(F.lit("s"), F.col("seq_id").cast("string"), F.lit("_"), F.col("header")) if prefix else F.col("header")


def metadata(sequences: DataFrame, prefix: bool = False, file: str = "documents") -> DataFrame:
    """seq_id, name (with `prefix` s<seq_id>_ before it), length and file."""
    own = F.col("file") if "file" in sequences.columns else F.lit(file)
    if "start" in sequences.columns:
        sequences = sequences.where("start = 0")
    return sequences.select("seq_id", name(prefix).alias("name"), "length", own.alias("file"))
