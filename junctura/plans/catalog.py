"""Queries of the junction graph, by name, with the same results in DuckDB's SQL.

Sequences are derived from `documents`; see sources.sequences.VARIANTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators import junctions, packed, segments, windows
from junctura.plans import formats, oracle
from junctura.plans.graph import JunctionGraph
from junctura.sources import fasta, junction_file, sequences
from junctura.storage import new_path, written

CHUNK_LETTERS = 1000
LOOKED_UP = ["ACGTACGTACG", "TGACTGACTGA", "AAAAAAAAAAA", "CATCATCATCA", "TTTTTTTTTTT", "ATATATATATA"]
BINS, ROUNDS, ABUNDANCE = 1024, 3, 5


def _seqs(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return sequences.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), variant)


def _graph(spark: SparkSession, sf_dir: str, variant: str = "clean", k: int = 11, abundance: int | None = None) -> JunctionGraph:
    return JunctionGraph(_seqs(spark, sf_dir, variant), k, abundance)


def q01_fasta_parse(spark, sf_dir):
    """Documents are written as FASTA files and read back by byte ranges."""
    path = new_path(spark, "fasta-files")
    sequences.to_fasta(_seqs(spark, sf_dir, "clean")).select("fasta").write.text(path)
    records = fasta.whole(fasta.read_fasta(spark, path))
    number = F.substr("header", F.lit(4)).cast("long")
    return records.select(number.alias("seq_id"), "header", "length", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def q02_letter_classes(spark, sf_dir):
    own = _seqs(spark, sf_dir, "iupac")
    return own.select("seq_id", dna.is_valid(F.col("seq")).alias("valid"), dna.is_definite(F.col("seq")).alias("definite"), F.md5(dna.normalised(F.col("seq")).cast("binary")).alias("normalised_md5"))


def q03_chunks(spark, sf_dir):
    return windows.chunks(_seqs(spark, sf_dir, "iupac"), CHUNK_LETTERS, 12, least=11).select("seq_id", "chunk_no", "start", "is_final", "len")


def q04_metadata(spark, sf_dir):
    names = sequences.metadata(_seqs(spark, sf_dir, "clean"), prefix=True)
    return names.join(formats.gfa1_inputs(names), "seq_id").select("seq_id", "name", "length", "file", "line")


def q05_junction_file(spark, sf_dir):
    """Positions are written to one binary file and read back by ranges of records."""
    path = new_path(spark, "junction-file")
    junction_file.write(_graph(spark, sf_dir).positions, path)
    return junction_file.read(spark, path)


def q06_marks(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = junction_file.marks(g.positions, g.sequences)
    return found.select("seq_id", F.size("marks").cast("long").alias("n_marks"), F.aggregate("marks", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_pos"))


def q07_seq_lines(spark, sf_dir):
    return formats.seq_lines(_graph(spark, sf_dir, "gapped").positions)


def q08_group_lines(spark, sf_dir):
    return formats.group_lines(packed.dealt(_graph(spark, sf_dir).runs), dealt=True)


def q09_dot_lines(spark, sf_dir):
    return formats.dot_lines(segments.pairs(_graph(spark, sf_dir).runs))


def q10_pieces(spark, sf_dir):
    return _graph(spark, sf_dir).pieces


def q11_segments(spark, sf_dir):
    return formats.segment_lines(_graph(spark, sf_dir).segments, 1)


def _names(g):
    return sequences.metadata(g.sequences)


def q12_gfa1_occurrences(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.occurrence_lines(g.labelled(), g.k, 1)


def q13_gfa1_links(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.link_lines(g.links, g.k, 1)


def q14_gfa1_paths(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.path_lines(g.dealt_paths, _names(g), 1)


def q15_gfa2_segments(spark, sf_dir):
    return formats.segment_lines(_graph(spark, sf_dir).segments, 2)


def q16_gfa2_occurrences(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.occurrence_lines(g.labelled(), g.k, 2)


def q17_gfa2_links(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.link_lines(g.links, g.k, 2)


def q18_gfa2_paths(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return formats.path_lines(g.dealt_paths, _names(g), 2)


def q19_fasta_lines(spark, sf_dir):
    return formats.fasta_lines(_graph(spark, sf_dir).segments)


def q20_respell(spark, sf_dir):
    g = _graph(spark, sf_dir)
    spelled = fasta.whole(segments.respelled(g.numbered.select("seq_id", F.col("start").alias("part"), F.col("segment").alias("path")), g.segments, g.k)).withColumnRenamed("seq", "spelled")
    joined = spelled.select("seq_id", "spelled").join(g.sequences.select("seq_id", "seq"), "seq_id")
    return joined.select("seq_id", (F.col("spelled") == F.col("seq")).alias("same"), F.md5(F.col("spelled").cast("binary")).alias("spelled_md5"))


def q21_link_overlaps(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return segments.overlaps(g.links, g.segments, g.k)


def q22_metrics(spark, sf_dir):
    """What was counted while junctions and positions were written; nothing is read again for it."""
    g = _graph(spark, sf_dir, "gapped")
    g.runs  # noqa: B018
    seen = {c: g.counted[c] for c in ("true_junctions", "false_junctions", "table_size", "marks", "positions")}
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in seen.items()], F.lit(2 * seen["true_junctions"]).cast("long").alias("vertices"))


def q23_kmers(spark, sf_dir):
    return windows.definite(_graph(spark, sf_dir, "gapped").windows).select("seq_id", "pos", "kmer")


def q24_rounds(spark, sf_dir):
    return junctions.junctions_in_rounds(written(_graph(spark, sf_dir).vertices, "vertices"), BINS, ROUNDS)


def q25_junctions_k11(spark, sf_dir):
    return _graph(spark, sf_dir, "gapped").vertices.where(junctions.is_junction())


def q25_junctions_k25(spark, sf_dir):
    return _graph(spark, sf_dir, "gapped", 25).vertices.where(junctions.is_junction())


def q26_abundance(spark, sf_dir):
    return _graph(spark, sf_dir, "gapped", abundance=ABUNDANCE).junctions


def q27_stubs(spark, sf_dir):
    g = _graph(spark, sf_dir, "gapped", 25)
    return g.stubs.select("seq_id", "pos", "junction_id")


def q28_signed_lookup(spark, sf_dir):
    g = _graph(spark, sf_dir, "gapped")
    return g.found.select("seq_id", "pos", "junction_id")


def q29_id_lookup(spark, sf_dir):
    return junctions.lookup(junctions.kmer_table(spark, LOOKED_UP), _graph(spark, sf_dir).junctions)


def q30_edge_degrees(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return junctions.edge_degrees(g.sequences, g.occurrences, g.k)


def q31_kmer_counts(spark, sf_dir):
    return _graph(spark, sf_dir).vertices.select("ck", "n")


def q32_both_strands(spark, sf_dir):
    found = packed.both_strands(_seqs(spark, sf_dir, "clean"), 9).where(junctions.is_junction())
    return packed.named(found, 9).select(F.col("ck").alias("kmer"), "in_degree", "out_degree")


def q33_ids(spark, sf_dir):
    found = _graph(spark, sf_dir).vertices
    back = junctions.junctions(found, backwards=True).select("ck", F.col("id").alias("packed_id"))
    return junctions.junctions(found).select("ck", "id").join(back, "ck")


def q34_reserved_segments(spark, sf_dir):
    return _graph(spark, sf_dir, "gapped").reserved.select("seq_id", "begin", "end", "b", "e", "segment_id")


def q35_reverse_complement(spark, sf_dir):
    rc = dna.reverse_complement(F.col("seq"))
    return _seqs(spark, sf_dir, "clean").select("seq_id", F.md5(rc.cast("binary")).alias("rc_md5"), (F.col("seq") < rc).alias("less"))


def q36_canonical(spark, sf_dir):
    return _graph(spark, sf_dir).occurrences.select("seq_id", "pos", "ck", "forward", "cin", "cout")


def q37_packing(spark, sf_dir):
    found = _graph(spark, sf_dir).vertices.select("ck")
    number = dna.packed(F.col("ck"))
    return found.select("ck", number.alias("packed"), dna.packed_backwards(F.col("ck")).alias("packed_backwards"), dna.unpacked(number, 11).alias("unpacked"))


def q38_extended_kmers(spark, sf_dir):
    return junctions.by_extended_kmers(_graph(spark, sf_dir, "gapped").occurrences).where(junctions.is_junction())


def q39_bounded_rounds(spark, sf_dir):
    """Junctions by an aggregation for each round of hash ranges, chosen by counts of occurrences before."""
    found, _ = packed.degrees_in_rounds(written(_seqs(spark, sf_dir, "clean"), "sequences"), 11, BINS, ROUNDS)
    return packed.named(found, 11).where(junctions.is_junction())


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}
ORACLE_SQL = oracle.statements(CHUNK_LETTERS, LOOKED_UP, BINS, ROUNDS, ABUNDANCE)
