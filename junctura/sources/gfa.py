"""GFA files of either version, read back: segments, links and paths, whether links overlap as they say, and the sequences that paths spell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators import segments
from junctura.plans import writers
from junctura.storage import written


@dataclass
class Gfa:
    """segments (id, body), links (a and b signed, the bounds a_low, a_high, b_low and b_high of what they share in each body), and paths (seq_id, name, part, path)."""

    version: int
    k: int
    segments: DataFrame
    links: DataFrame
    paths: DataFrame


def _signed(step: Column) -> Column:
    """The number of a step like 12-; anything else is an error."""
    wrong = F.raise_error(F.concat(F.lit("no step of a path: "), step)).cast("long")
    number = F.regexp_extract(step, r"^([0-9]+)[+-]$", 1)
    return F.when(number == "", wrong).when(F.endswith(step, F.lit("-")), -number.cast("long")).otherwise(number.cast("long"))


def read(spark: SparkSession, path: str) -> Gfa:
    """The tables of a GFA file (or of a folder of them that is one graph).

    The version is the header's, and k that of the links (0 without any). Input sequences and other
    segments without a body are left out; a body that a segment has twice is an error.
    """
    lines = written(spark.read.text(path).select(F.split("value", "\t").alias("x")).where(F.get("x", F.lit(0)).isin("H", "S", "L", "E", "P", "O")), "gfa")
    field = lambda n: F.get("x", F.lit(n))
    of = lambda *kinds: lines.where(field(0).isin(*kinds))
    header = of("H").select(F.max(field(1))).first()[0] or ""
    version = 2 if header.startswith("VN:Z:2") else 1
    body = field(2 if version == 1 else 3)
    found = of("S").where(body != "*").groupBy(field(1).cast("long").alias("id")).agg(F.min(body).alias("body"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("a segment is there twice: "), F.col("id").cast("string")))
    bodies = found.select("id", F.when(F.col("n") == 1, F.col("body")).otherwise(twice.cast("string")).alias("body"))
    if version == 1:
        a, b, shared = F.concat(field(1), field(2)), F.concat(field(3), field(4)), field(5)
    else:
        a, b, shared = field(1), field(2), field(7)
    k = shared.substr(F.lit(1), F.length(shared) - 1).cast("int")
    rows = of("L" if version == 1 else "E")
    most = rows.agg(F.max(k)).first()[0] or 0
    bound = lambda n: F.regexp_replace(field(n), r"\$", "").cast("long")
    bounds = [bound(n) if version == 2 else F.lit(None).cast("long") for n in range(3, 7)]
    links = rows.select(_signed(a).alias("a"), _signed(b).alias("b"), k.alias("k"), *[x.alias(c) for x, c in zip(bounds, ("a_low", "a_high", "b_low", "b_high"), strict=True)])
    steps = F.split(field(2), "," if version == 1 else " ")
    name = field(1) if version == 1 else F.regexp_replace(field(1), "p$", "")
    paths = written(of("P" if version == 1 else "O").select(name.alias("name"), F.transform(steps, _signed).alias("path")).withColumn("seq_id", F.monotonically_increasing_id()), "gfa-paths")
    return Gfa(version, most, bodies, links, paths.select("seq_id", "name", F.lit(0).cast("long").alias("part"), "path"))


def overlaps(graph: Gfa) -> DataFrame:
    """One row: the number of links, and of those whose segments differ in what they share (or one of which is not there).

    Version 2 says where that is in each body; in version 1 it is the end of the first and the beginning of the second, as they are read.
    """
    size = F.length("body").cast("long")
    known = graph.segments.select("id", F.col("body").cast("binary").alias("body"), size.alias("size"))

    def share(side: str, at_end: Column) -> Column:
        own = F.col(f"{side}_size")
        low = F.coalesce(f"{side}_low", F.when(at_end, own - F.col("k")).otherwise(F.lit(0)))
        high = F.coalesce(f"{side}_high", F.when(at_end, own).otherwise(F.col("k")))
        cut = F.substring(f"{side}_body", (low + 1).cast("int"), (high - low).cast("int")).cast("string")
        return F.when(F.col(side) > 0, cut).otherwise(dna.reverse_complement(cut))

    rows = graph.links
    for side in "ab":
        named = known.select(F.col("id").alias(f"{side}_id"), F.col("body").alias(f"{side}_body"), F.col("size").alias(f"{side}_size"))
        rows = rows.join(named, F.abs(side) == F.col(f"{side}_id"), "left")
    same = share("a", F.col("a") > 0) == share("b", F.col("b") < 0)
    return rows.agg(F.count("*").alias("links"), F.count_if(~F.coalesce(same, F.lit(False))).alias("violations"))


def spelled(graph: Gfa) -> DataFrame:
    """seq_id, header (the path's name), start, seq and length of the pieces of the sequences that paths spell."""
    pieces = segments.respelled(graph.paths, graph.segments.withColumnRenamed("id", "segment_id"), graph.k)
    return pieces.join(graph.paths.select("seq_id", F.col("name").alias("header")), "seq_id")


def fasta_lines(pieces: DataFrame) -> DataFrame:
    """Rows of a FASTA file with a line for each sequence, as writers' formats have them."""
    last = F.col("start") + F.length("seq") == F.col("length")
    heads = pieces.select("seq_id", "header").distinct().select("seq_id", F.lit(-1).alias("pos"), F.concat(F.lit(">"), "header").alias("line"), F.lit(False).alias("open"))
    return writers.part(heads.unionByName(pieces.select("seq_id", F.col("start").alias("pos"), F.col("seq").alias("line"), (~last).alias("open"))), 1)
