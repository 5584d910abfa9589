"""The junction graph of a table of sequences, and what can be asked of it or written from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from junctura.operators import junctions, packed, segments, windows
from junctura.plans import writers
from junctura.sources import positional, sequences
from junctura.storage import written


class JunctionGraph:
    """Tables of the compacted de Bruijn graph of `sequences`: seq_id, header, seq and length, or pieces of sequences with their `start`.

    What several other tables start from is written to the shared folder when it is first asked for; all else is lazy. k-mers are
    keyed by numbers where they fit one (k up to packed.MOST), else by their letters. Letters other than A, C, G and T are unknown ones.

    `placed` gives known positions (seq_id, pos, junction_id) instead, as read from a junction file.
    """

    def __init__(self, sequences: DataFrame, k: int = 25, abundance: int | None = None, placed: DataFrame | None = None):
        windows.check_k(k)
        self.sequences, self.k, self.abundance, self._placed, self._kept = sequences, k, abundance, placed, False

    def _keep(self) -> None:
        """Writes the sequences, before the first of several passes over them: what they are made of is not read again."""
        if not self._kept:
            self.sequences, self._kept = written(self.sequences, "sequences"), True

    @property
    def definite(self) -> DataFrame:
        return self.sequences.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "N"))

    @cached_property
    def windows(self) -> DataFrame:
        return windows.kmers(self.definite, self.k)

    @cached_property
    def occurrences(self) -> DataFrame:
        return windows.canonical(windows.definite(self.windows))

    @cached_property
    def codes(self) -> DataFrame:
        """Occurrences keyed by numbers (packed.occurrences), for k up to packed.MOST."""
        return packed.occurrences(self.sequences, self.k)

    @cached_property
    def _degrees(self) -> DataFrame:
        if packed.LEAST <= self.k <= packed.MOST:
            self._keep()  # their letters are counted first
        return packed.degrees(self.sequences, self.k) if self.k <= packed.MOST else junctions.vertices(self.occurrences)

    def _named(self, vertices: DataFrame) -> DataFrame:
        return packed.named(vertices, self.k) if self.k <= packed.MOST else vertices

    @cached_property
    def vertices(self) -> DataFrame:
        return self._named(self._degrees)

    @cached_property
    def counted(self) -> dict[str, int]:
        """What was counted while tables were written: of vertices (true_junctions, false_junctions, table_size, kmers, marks), and positions."""
        return {}

    def _observed(self, df: DataFrame, *counts) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return df.observe(seen, *counts), seen

    @cached_property
    def junctions(self) -> DataFrame:
        real = junctions.is_junction(self.abundance)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        rows, seen = self._observed(
            self._degrees, F.count_if(real).alias("true_junctions"), F.count_if(~real).alias("false_junctions"), F.count(F.lit(1)).alias("table_size"),
            total("n").alias("kmers"), total(F.when(real, F.col("n"))).alias("marks"),
        )
        # Written before they are ordered: a range's bounds are sampled, and the aggregation is not run twice for that.
        found = written(self._named(rows.where(real)), "branching")
        self.counted.update(seen.get)
        return written(junctions.junctions(found, self.abundance), "junctions")

    @cached_property
    def stubs(self) -> DataFrame:
        """seq_id, pos, junction_id, prev and next of the sequences' ends that are no junctions."""
        self._keep()
        return junctions.stubs(windows.terminals(self.definite, self.k), self.junctions)

    def _runs(self, ends: DataFrame | None = None) -> DataFrame:
        return junctions.runs(self.sequences, self.codes if self.k <= packed.MOST else self.occurrences, self.k, self.junctions, ends)

    @property
    def found(self) -> DataFrame:
        """seq_id, pos, junction_id, prev and next of the junctions' occurrences alone."""
        self._keep()
        return packed.rows(self._runs())

    @cached_property
    def runs(self) -> DataFrame:
        """All positions, as packed.RUNS: a row for each range of windows.CHUNK of them that has any."""
        if "positions" in self.__dict__:
            return written(packed.runs(self.positions), "runs")
        self._keep()
        if self._placed is None:
            found = self._runs(self.stubs)
        else:
            found = packed.runs(junctions.with_letters(self._placed, self.definite, self.k))
        found, seen = self._observed(found, F.coalesce(F.sum(F.size("id")), F.lit(0)).alias("positions"))
        found = written(found, "runs")
        self.counted.update(seen.get)
        return found

    @cached_property
    def positions(self) -> DataFrame:
        """seq_id, pos, junction_id, prev and next of each position, from the runs."""
        return packed.rows(self.runs)

    @cached_property
    def _numbered(self) -> DataFrame:
        return packed.numbered(segments.steps(self.runs))

    @cached_property
    def reserved(self) -> DataFrame:
        """The pieces whose segments begin with an indefinite letter, with their ids in order of emission."""
        return segments.reserved(self._numbered)

    @cached_property
    def numbered(self) -> DataFrame:
        """Runs with the ids of the segments between their positions; what is asked of pieces is made of these."""
        return segments.filled(self._numbered, self.reserved)

    def labelled(self, prefix: bool = False) -> DataFrame:
        """numbered, with the name and the length of each run's sequence; names are joined only to runs that do not have them."""
        if packed.names(self.numbered):
            return self.numbered.withColumn("name", sequences.name(prefix))
        return self.numbered.join(sequences.metadata(self.sequences, prefix).select("seq_id", "name", "length"), "seq_id")

    @cached_property
    def pieces(self) -> DataFrame:
        return segments.pieces(self.numbered)

    @cached_property
    def segments(self) -> DataFrame:
        return segments.bodies(written(segments.first_seen(self.numbered), "firsts"), self.sequences, self.k)

    @cached_property
    def links(self) -> DataFrame:
        return segments.links(self.numbered, self.k)

    @cached_property
    def paths(self) -> DataFrame:
        return segments.paths(self.numbered)

    @property
    def dealt_paths(self) -> DataFrame:
        """paths, dealt out by sequence: one shuffle then brings whole lines together."""
        return segments.paths(self.numbered.repartition("seq_id"))

    def lines(self, fmt: str, prefix: bool = False) -> DataFrame:
        """section, seq_id, pos, n, part, line and open of a format, to be ordered by the first five; what is `open` goes on in the next row."""
        return writers.named(fmt).lines(self, prefix)

    def write(self, fmt: str, path: str, prefix: bool = False) -> int:
        """Writes one text file, by all tasks at their places in it; returns its bytes."""
        return positional.write(self.lines(fmt, prefix), writers.ORDER, positional.text_lines, path)
