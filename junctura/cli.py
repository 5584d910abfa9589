"""Command line: `build` finds the junctions of genomes, `dump` writes a graph as text, `spell` genomes from a GFA file."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from junctura.plans import writers
from junctura.plans.graph import JunctionGraph
from junctura.sources import gfa, junction_file, positional
from junctura.sources.fasta import read_fasta

log = logging.getLogger("junctura")


def odd(text: str) -> int:
    if int(text) < 1 or int(text) % 2 == 0:
        raise argparse.ArgumentTypeError("k must be odd")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="junctura")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="write the junction positions of FASTA files")
    build.add_argument("-k", "--kvalue", type=odd, default=25)
    build.add_argument("-a", "--abundance", type=int, help="leave out junctions that occur more often")
    build.add_argument("-o", "--outfile", default="de_bruijn.bin")
    # Sizes of filters, hash functions, rounds, threads and a temporary folder are Spark's concern; they are taken and ignored.
    for flags in (("-f", "--filtersize"), ("--filtermemory",), ("-q", "--hashfnumber"), ("-r", "--rounds"), ("-t", "--threads"), ("--tmpdir",)):
        build.add_argument(*flags, help=argparse.SUPPRESS)
    build.add_argument("files", nargs="+")
    dump = sub.add_parser("dump", help="write a graph as text")
    dump.add_argument("-k", "--kvalue", type=odd, required=True)
    dump.add_argument("-f", "--format", choices=writers.names(), required=True)
    dump.add_argument("-s", "--seqfilename", action="append", default=[])
    dump.add_argument("--prefix", action="store_true")
    dump.add_argument("-o", "--outfile", help="the file to write (standard output if it is not given)")
    dump.add_argument("infile")
    spell = sub.add_parser("spell", help="write the sequences of a GFA file's paths as FASTA, after a check of its links")
    spell.add_argument("-o", "--outfile", required=True)
    spell.add_argument("infile")
    return top


def build(spark: SparkSession, given: argparse.Namespace) -> None:
    """Writes the junction file, and logs what the build counts on its way, without a further pass."""
    began = time.perf_counter()
    log.info("k = %d, %d files", given.kvalue, len(given.files))
    graph = JunctionGraph(read_fasta(spark, *given.files), given.kvalue, given.abundance)
    counted, junctions = graph.counted, graph.junctions.count()
    log.info("%d junctions among %d vertices, %d k-mers, %.1f s", junctions, counted["table_size"], counted["kmers"], time.perf_counter() - began)
    size = junction_file.write(graph.positions, given.outfile)
    log.info("%d marks, %d positions, %d bytes, %.1f s", counted["marks"], counted["positions"], size, time.perf_counter() - began)


def dump(spark: SparkSession, given: argparse.Namespace) -> None:
    if not given.seqfilename and writers.named(given.format).needs_sequences:
        raise SystemExit("this format needs the sequences (-s)")
    placed = junction_file.read(spark, given.infile)
    if given.seqfilename:
        graph = JunctionGraph(read_fasta(spark, *given.seqfilename), given.kvalue, placed=placed)
    else:
        graph = JunctionGraph(spark.range(0).selectExpr("id as seq_id", "'' as header", "'' as seq", "id as length"), given.kvalue)
        graph.positions = placed.withColumns({"prev": F.lit("N"), "next": F.lit("N")})
    if given.outfile:
        graph.write(given.format, given.outfile, given.prefix)
        return
    rows = graph.lines(given.format, given.prefix).orderBy(*writers.ORDER).select("line", "open")
    for row in rows.toLocalIterator(prefetchPartitions=True):
        sys.stdout.write(row.line if row.open else row.line + "\n")


def spell(spark: SparkSession, given: argparse.Namespace) -> None:
    graph = gfa.read(spark, given.infile)
    found = gfa.overlaps(graph).first()
    if found.violations:
        raise SystemExit(f"{found.violations} of {found.links} links join segments that differ in their overlap")
    size = positional.write(gfa.fasta_lines(gfa.spelled(graph)), writers.ORDER, positional.text_lines, given.outfile)
    log.info("%d links, %d bytes", found.links, size)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("junctura").getOrCreate()
    {"build": build, "dump": dump, "spell": spell}[given.command](spark, given)


if __name__ == "__main__":
    main()
