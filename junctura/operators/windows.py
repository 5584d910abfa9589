"""Sliding windows: sequences are cut into short chunks first, so that no substring walks a long text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import dna

#: Windows per chunk.
CHUNK = 512


def check_k(k: int) -> None:
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be odd, so that no k-mer is its own reverse complement")


def pieces(sequences: DataFrame, *kept: str) -> DataFrame:
    """seq_id, start, seq and length of the pieces of sequences, and the columns `kept`; a table without `start` has a sequence in each row."""
    n = F.col("length") if "length" in sequences.columns else F.length("seq").cast("long")
    start = F.col("start") if "start" in sequences.columns else F.lit(0).cast("long")
    return sequences.select("seq_id", start.alias("start"), "seq", n.alias("length"), *kept)


def _cut(sequences: DataFrame, step: int, width: int, count: Column, least: int, pad: str = "", kept: tuple[str, ...] = ()) -> DataFrame:
    """seq_id, chunk_no, n (length with pads), count, the columns `kept` (the same in all pieces of a sequence) and letters: chunk i has `width` letters from i * step of pad + sequence + pad.

    Chunks that lie within one piece are cut there; of those that a border of pieces crosses, parts meet by (seq_id, chunk_no).
    """
    own, edge = pieces(sequences, *kept).where(F.col("length") >= least), len(pad)
    first, last = F.col("start") == 0, F.col("start") + F.length("seq") == F.col("length")
    text = F.concat(F.when(first, F.lit(pad)).otherwise(F.lit("")), "seq", F.when(last, F.lit(pad)).otherwise(F.lit(""))).cast("binary")
    own = own.select("seq_id", text.alias("b"), F.when(first, F.lit(0)).otherwise(F.col("start") + edge).cast("long").alias("low"), (F.col("length") + 2 * edge).alias("n"), *kept)
    own = own.select("*", (F.col("low") + F.length("b")).alias("high"), count.cast("long").alias("count"))
    at, to = F.greatest(F.lit(0).cast("long"), F.floor((F.col("low") - width) / step) + 1), F.least(F.col("count") - 1, F.floor((F.col("high") - 1) / step))
    numbers = F.when(at <= to, F.sequence(at, to)).otherwise(F.array().cast("array<bigint>"))
    begin = lambda i: F.greatest(i * step, F.col("low"))
    end = lambda i: F.least(i * step + width, F.col("high"))
    whole = lambda i: (i * step >= F.col("low")) & (F.least(i * step + width, F.col("n")) <= F.col("high"))
    # Binary substrings are cut by offset; of UTF-8 strings they would walk from the start.
    part = lambda i: F.struct(i.alias("chunk_no"), begin(i).alias("at"), F.substring("b", (begin(i) - F.col("low") + 1).cast("int"), (end(i) - begin(i)).cast("int")).cast("string").alias("letters"))
    rows = lambda chosen: own.select("seq_id", "n", "count", *kept, F.explode(F.transform(chosen, part)).alias("c"))
    # Chunks are dealt out before they are exploded into many times as many bytes: a huge record, or input of few splits, is then work for all tasks.
    spark = sequences.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows(F.filter(numbers, whole) if "start" in sequences.columns else numbers).repartition(parts, "seq_id", "c.chunk_no").select("seq_id", "c.chunk_no", "n", "count", *kept, "c.letters")
    if "start" in sequences.columns:
        across = rows(F.filter(numbers, lambda i: ~whole(i))).groupBy("seq_id", "c.chunk_no", "n", "count", *kept).agg(F.array_sort(F.collect_list(F.struct("c.at", "c.letters"))).alias("parts"))
        found = found.unionByName(across.select("seq_id", "chunk_no", "n", "count", *kept, F.array_join(F.transform("parts", lambda x: x["letters"]), "").alias("letters")))
    return found


def chunks(sequences: DataFrame, size: int, overlap: int, least: int = 1, kept: tuple[str, ...] = ()) -> DataFrame:
    """seq_id, chunk_no, start, is_final, len and letters of overlapping chunks of N + seq + N; with columns `kept`, these and the sequence's length, too."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / step))
    rows = _cut(sequences, step, size, count, least, "N", kept)
    more = [*kept, (F.col("n") - 2).alias("length")] if kept else []
    return rows.select("seq_id", "chunk_no", (F.col("chunk_no") * step).alias("start"), (F.col("chunk_no") == F.col("count") - 1).alias("is_final"), F.length("letters").cast("long").alias("len"), "letters", *more)


def tiles(sequences: DataFrame, size: int, extra: int) -> DataFrame:
    """seq_id, tile and letters: `size` letters from tile * size, and up to `extra` more."""
    return _cut(sequences, size, size + extra, F.ceil(F.col("n") / size), 1).select("seq_id", F.col("chunk_no").alias("tile"), "letters")


def kmers(sequences: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """seq_id, pos, kmer, prev, next and is_last of every window; N stands before and after each sequence."""
    cut = chunks(sequences, size + k + 1, k + 1, least=k)
    places = F.sequence(F.lit(0).cast("long"), F.col("len") - (k + 2))
    rows = cut.where(F.col("len") >= k + 2).select("seq_id", "start", "is_final", "len", "letters", F.explode(places).alias("at"))
    at = F.col("at").cast("int")
    return rows.select(
        "seq_id", (F.col("start") + F.col("at")).alias("pos"), F.substr("letters", at + 2, F.lit(k)).alias("kmer"),
        F.substr("letters", at + 1, F.lit(1)).alias("prev"), F.substr("letters", at + k + 2, F.lit(1)).alias("next"),
        (F.col("is_final") & (F.col("at") == F.col("len") - (k + 2))).alias("is_last"),
    )


def terminals(sequences: DataFrame, k: int) -> DataFrame:
    """The first and the last window of each sequence (one row if they are the same), as kmers() has them.

    Of sequences in pieces they are cut from the first and the last chunk.
    """
    if "start" in sequences.columns:
        ends = chunks(sequences, CHUNK + k + 1, k + 1, least=k).where("chunk_no = 0 or is_final")
        b, last = F.col("letters").cast("binary"), F.col("len") - (k + 2)
        places = F.array_distinct(F.concat(F.when(F.col("chunk_no") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col("is_final"), F.array(last)).otherwise(F.array().cast("array<bigint>"))))
        rows = ends.select("seq_id", "start", b.alias("b"), "is_final", last.alias("last"), F.explode(places).alias("pos"))
    else:
        n = F.length("seq").cast("long")
        own = sequences.where(n >= k).select("seq_id", F.concat(F.lit("N"), "seq", F.lit("N")).cast("binary").alias("b"), (n - k).alias("last"))
        rows = own.select("seq_id", F.lit(0).alias("start"), "b", F.lit(True).alias("is_final"), "last", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("last")))).alias("pos"))
    at = F.col("pos").cast("int")
    cut = lambda start, size: F.substring("b", start, size).cast("string")
    is_last = F.col("is_final") & (F.col("pos") == F.col("last"))
    return rows.select("seq_id", (F.col("start") + F.col("pos")).alias("pos"), cut(at + 2, F.lit(k)).alias("kmer"), cut(at + 1, F.lit(1)).alias("prev"), cut(at + k + 2, F.lit(1)).alias("next"), is_last.alias("is_last"))


def definite(windows: DataFrame) -> DataFrame:
    return windows.where(~F.contains("kmer", F.lit("N")))


def canonical(windows: DataFrame) -> DataFrame:
    """Adds ck (the smaller strand), forward, and what comes before and after ck: cin and cout."""
    both = windows.withColumn("rc", dna.reverse_complement(F.col("kmer")))
    forward = F.col("kmer") < F.col("rc")
    return both.select(
        *windows.columns, F.least("kmer", "rc").alias("ck"), forward.alias("forward"),
        F.when(forward, F.col("prev")).otherwise(dna.complement(F.col("next"))).alias("cin"),
        F.when(forward, F.col("next")).otherwise(dna.complement(F.col("prev"))).alias("cout"),
    )


def edges(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, pos and edge, the definite (k + 1)-letter window, with its canonical form."""
    cut = chunks(sequences, CHUNK + k, k, least=k + 1)
    places = F.sequence(F.lit(0).cast("long"), F.col("len") - (k + 1))
    rows = cut.where(F.col("len") >= k + 1).select("seq_id", "start", "letters", F.explode(places).alias("at"))
    edge = F.substr("letters", F.col("at").cast("int") + 1, F.lit(k + 1))
    found = rows.select("seq_id", (F.col("start") + F.col("at") - 1).alias("pos"), edge.alias("edge")).where(~F.contains("edge", F.lit("N")))
    return found.withColumn("canonical", F.least("edge", dna.reverse_complement(F.col("edge"))))
