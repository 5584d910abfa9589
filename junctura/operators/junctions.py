"""Vertices, junctions and their places: one exact aggregation of k-mers instead of a filter and a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators import packed, windows
from junctura.operators.ranking import ranked
from junctura.storage import written

#: The first id of a terminal that is no junction lies this far above the number of junctions.
STUB_OFFSET = 42
#: Junctions (16 bytes each, sorted) up to which they are sent to all tasks, and no k-mer is shuffled to find its junction: all that k = 11 can have.
BROADCAST_ROWS = 1 << 21


def vertex_state(occurrences: DataFrame) -> DataFrame:
    """ck with its count and both sides' letters: two sets (as bits) and two counts of N, combined before the shuffle."""
    sides = occurrences.select("ck", *[f(F.col(c)).alias(f"{c}_{n}") for c in ("cin", "cout") for n, f in (("set", dna.letter_bit), ("n", lambda x: (x == "N").cast("long")))])
    return sides.groupBy("ck").agg(
        F.count("*").alias("n"),
        F.bit_or("cin_set").alias("ins"), F.sum("cin_n").alias("in_n"),
        F.bit_or("cout_set").alias("outs"), F.sum("cout_n").alias("out_n"),
    )


def merged_state(states: DataFrame) -> DataFrame:
    """One state of each key from several: sets are united, counts added."""
    return states.groupBy("ck").agg(
        F.sum("n").alias("n"), F.bit_or("ins").alias("ins"), F.sum("in_n").alias("in_n"), F.bit_or("outs").alias("outs"), F.sum("out_n").alias("out_n")
    )


def degrees(state: DataFrame) -> DataFrame:
    """ck, n, in_degree, out_degree; every N neighbour counts as a letter of its own."""
    return state.select("ck", "n", (F.bit_count("ins") + F.col("in_n")).cast("long").alias("in_degree"), (F.bit_count("outs") + F.col("out_n")).cast("long").alias("out_degree"))


def vertices(occurrences: DataFrame) -> DataFrame:
    """ck, n, in_degree, out_degree of each canonical k-mer."""
    return degrees(vertex_state(occurrences))


def is_junction(abundance: int | None = None) -> Column:
    branches = (F.col("in_degree") > 1) | (F.col("out_degree") > 1)
    return branches if abundance is None else branches & (F.col("n") <= abundance)


def junctions(found: DataFrame, abundance: int | None = None, backwards: bool = False) -> DataFrame:
    """The vertices that branch (and occur at most `abundance` times) with their id, the rank of the key from 1.

    `backwards` ranks by the reversed key, the order of keys packed with the first letter least significant.
    """
    return ranked(found.where(is_junction(abundance)), [F.reverse("ck") if backwards else F.col("ck")], "id")


def signed(occurrences: DataFrame, known: DataFrame, how: str = "inner", key: str = "ck") -> DataFrame:
    """Adds junction_id: the id if the k-mer as read is the key, its negative if its reverse complement is."""
    joined = occurrences.join(known, key, how)
    return joined.withColumn("junction_id", F.when(F.col("forward"), F.col("id")).otherwise(-F.col("id"))).drop("id")


def lookup(spark_kmers: DataFrame, known: DataFrame) -> DataFrame:
    """kmer and its signed id (null if it is no junction) of a table of k-mers."""
    rc = dna.reverse_complement(F.col("kmer"))
    asked = spark_kmers.select("kmer", F.least(F.col("kmer"), rc).alias("ck"), (F.col("kmer") < rc).alias("forward"))
    return signed(asked, known.select("ck", "id"), "left").select("kmer", "junction_id")


def stubs(terminals: DataFrame, known: DataFrame) -> DataFrame:
    """seq_id, pos, junction_id, prev, next of each sequence's first and last k-mer where it is no junction: ids are counted in order of (seq_id, pos)."""
    total = known.agg(F.count("*")).scalar()
    ends = signed(windows.canonical(terminals), known.select("ck", "id"), "left").where("junction_id is null").drop("junction_id")
    # Written, since bounds of ranges are sampled: the sequences' ends are found once.
    found = ranked(written(ends, "ends"), ["seq_id", "pos"], "rank", STUB_OFFSET)
    return found.select("seq_id", "pos", (F.col("rank") + total).alias("junction_id"), "prev", "next")


def runs(sequences: DataFrame, occurrences: DataFrame, k: int, known: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """packed.RUNS of all junction occurrences and of `ends`, the stubs, if any.

    Occurrences are those of packed.occurrences() (keyed by a number) or of windows.canonical() (by letters). They are shuffled to
    their junctions only if these are more than BROADCAST_ROWS, or have no numbers.
    """
    numbers = known.select(dna.packed(F.col("ck")).alias("code"), "id") if k <= packed.MOST else known.select("ck", "id")
    if k <= packed.MOST and known.count() <= BROADCAST_ROWS:
        return packed.placed(sequences, k, numbers, None if ends is None else ends.select("seq_id", "pos", "junction_id"))
    real = signed(occurrences, numbers, key=numbers.columns[0])
    if k <= packed.MOST:
        real = real.withColumns({c: dna.letter_of(F.col(c)) for c in ("prev", "next")})
    real = real.select("seq_id", "pos", "junction_id", "prev", "next")
    return packed.runs(real if ends is None else real.unionByName(ends))


def with_letters(placed: DataFrame, sequences: DataFrame, k: int) -> DataFrame:
    """Adds prev and next, the letters around each position's k-mer (N at the ends), cut from the chunk that it lies in."""
    step = windows.CHUNK
    # Chunk i of N + seq + N has the k-mers from i * step up to (i + 1) * step, and the letters around them.
    cut = windows.chunks(sequences, step + k + 1, k + 1, least=k).select("seq_id", F.col("chunk_no").alias("chunk"), F.col("letters").cast("binary").alias("letters"))
    at = (F.col("pos") % step).cast("int")
    letter = lambda place: F.substring("letters", place + 1, F.lit(1)).cast("string")
    joined = placed.select("seq_id", "pos", "junction_id", F.floor(F.col("pos") / step).alias("chunk")).join(cut, ["seq_id", "chunk"])
    return joined.select("seq_id", "pos", "junction_id", letter(at).alias("prev"), letter(at + k + 1).alias("next"))


def edge_degrees(sequences: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """ck with how many of its eight possible neighbour edges are edges of the input: an exact membership test."""
    if k < packed.MOST:
        count = lambda shift: F.bit_count(F.shiftright("sides", shift).bitwiseAND(F.lit(15))).cast("long")
        return packed.named(packed.edge_sides(sequences, k).select("code", count(0).alias("in_edges"), count(4).alias("out_edges")), k)
    known = windows.edges(sequences, k).select("canonical").distinct()
    vertex = occurrences.select("ck").distinct()
    sides = [F.struct(F.lit(s).alias("side"), (F.concat(F.lit(c), "ck") if s == "in" else F.concat("ck", F.lit(c))).alias("edge")) for s in ("in", "out") for c in dna.DEFINITE]
    possible = vertex.select("ck", F.explode(F.array(*sides)).alias("x")).select("ck", "x.side", F.least("x.edge", dna.reverse_complement(F.col("x.edge"))).alias("canonical"))
    found = possible.join(known, "canonical", "left_semi").groupBy("ck").agg(F.count_if(F.col("side") == "in").alias("in_edges"), F.count_if(F.col("side") == "out").alias("out_edges"))
    return vertex.join(found, "ck", "left").select("ck", F.coalesce("in_edges", F.lit(0)).alias("in_edges"), F.coalesce("out_edges", F.lit(0)).alias("out_edges"))


def by_extended_kmers(occurrences: DataFrame) -> DataFrame:
    """The vertices by another way: distinct k-mers with the letters on both sides, (k + 2)-mers, are counted first, and then what each k-mer has of them."""
    extended = occurrences.groupBy("ck", "cin", "cout").agg(F.count("*").alias("n"))
    known = lambda c: F.count_distinct(F.when(F.col(c) != "N", F.col(c)))
    unknown = lambda c: F.sum(F.when(F.col(c) == "N", F.col("n")).otherwise(0))
    return extended.groupBy("ck").agg(F.sum("n").alias("n"), (known("cin") + unknown("cin")).cast("long").alias("in_degree"), (known("cout") + unknown("cout")).cast("long").alias("out_degree"))


def both_strands(occurrences: DataFrame) -> DataFrame:
    """Junctions by a plainer rule: each strand's k-mers with the distinct letters (and all N) on their sides."""
    strands = F.array(
        F.struct(F.col("kmer").alias("kmer"), F.col("prev").alias("prev"), F.col("next").alias("next")),
        F.struct(dna.reverse_complement(F.col("kmer")).alias("kmer"), dna.complement(F.col("next")).alias("prev"), dna.complement(F.col("prev")).alias("next")),
    )
    rows = occurrences.select(F.explode(strands).alias("s")).select("s.*")
    own = lambda c: (F.bit_count(F.bit_or(dna.letter_bit(F.col(c)))) + F.count_if(F.col(c) == "N")).cast("long")
    return rows.groupBy("kmer").agg(own("prev").alias("in_degree"), own("next").alias("out_degree")).where(is_junction())


def portable_hash(key: Column) -> Column:
    """32 bits of an MD5: the same in other engines."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def histogram(found: DataFrame, bins: int) -> DataFrame:
    """bin and n: how many vertices fall into each of `bins` equal ranges of the hash."""
    return found.select(F.floor(portable_hash(F.col("ck")) * bins / (1 << 32)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def rounds(counts: DataFrame, n_rounds: int) -> DataFrame:
    """bin and round of an equi-depth split: a bin's round follows from the running count before it."""
    from pyspark.sql import Window

    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.select("bin", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return running.select("bin", "n", F.floor(F.col("before") * n_rounds / F.col("total")).cast("long").alias("round"))


def junctions_in_rounds(found: DataFrame, bins: int, n_rounds: int) -> DataFrame:
    """ck and round of the junctions among `found` vertices: a round holds a range of bins, about as many keys as any other.

    A key lies in one round, so all rounds together find what a single one does.
    """
    split = rounds(histogram(found, bins), n_rounds).select("bin", "round")
    bin_ = F.floor(portable_hash(F.col("ck")) * bins / (1 << 32)).cast("long")
    # At most `bins` rows.
    return found.where(is_junction()).withColumn("bin", bin_).join(F.broadcast(split), "bin").select("ck", "round")


def kmer_table(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}')" for v in values) + " AS t(kmer)")
