"""Output formats by name: a format is a class that gives the lines of a graph; register() adds one, to the library and to the command line."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.operators import segments
from junctura.plans import formats
from junctura.sources import sequences

if TYPE_CHECKING:
    from junctura.plans.graph import JunctionGraph

#: What lines are ordered by.
ORDER = ["section", "seq_id", "pos", "n", "part"]
#: A place after all of a sequence.
AFTER = 1 << 62


class Format:
    """A text format. A subclass has a name and gives its lines: rows of sections, which part() and single() make."""

    name = ""
    #: Whether letters of the sequences are needed, besides positions.
    needs_sequences = False

    def lines(self, graph: JunctionGraph, prefix: bool = False) -> DataFrame:
        """section, seq_id, pos, n, part, line and open; see JunctionGraph.lines()."""
        raise NotImplementedError


def part(rows: DataFrame, section: int, n: int = 0) -> DataFrame:
    """Rows of a section, in order of what they have of seq_id, pos, n (else the number given) and part."""
    has = lambda c, other: (F.col(c) if c in rows.columns else F.lit(other)).cast("long").alias(c)
    open_ = F.col("open") if "open" in rows.columns else F.lit(False)
    return rows.select(F.lit(section).alias("section"), has("seq_id", -1), has("pos", AFTER), has("n", n), has("part", 0), "line", open_.alias("open"))


def single(graph: JunctionGraph, line: str, section: int) -> DataFrame:
    return part(graph.sequences.sparkSession.range(1).select(F.lit(line).alias("line")), section)


def together(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_FORMATS: dict[str, Format] = {}


def register(fmt: type[Format]) -> type[Format]:
    """Adds a format under its name, in place of one that has it."""
    if not fmt.name:
        raise ValueError("a format has a name")
    _FORMATS[fmt.name] = fmt()
    return fmt


def names() -> list[str]:
    return list(_FORMATS)


def named(name: str) -> Format:
    if name not in _FORMATS:
        raise ValueError(f"the formats are {', '.join(_FORMATS)}")
    return _FORMATS[name]


@register
class Seq(Format):
    name = "seq"

    def lines(self, graph, prefix=False):
        return part(formats.seq_lines(graph.positions), 1)


@register
class Group(Format):
    name = "group"

    def lines(self, graph, prefix=False):
        return part(formats.group_pieces(graph.positions), 1)


@register
class Dot(Format):
    name = "dot"

    def lines(self, graph, prefix=False):
        edges = part(formats.dot_lines(segments.pairs(graph.runs)), 1)
        return together(single(graph, "digraph G\n{\n\trankdir = LR", 0), edges, single(graph, "}", 2))


class Gfa(Format):
    needs_sequences, version = True, 0

    def lines(self, graph, prefix=False):
        found, v = sequences.metadata(graph.sequences, prefix), self.version
        paths = formats.path_pieces(graph.paths, found, v).withColumnsRenamed({"n": "part"})
        rows = [
            single(graph, f"H\tVN:Z:{v}.0", 0),
            part(formats.segment_lines(graph.segments, v), 2, 0),
            part(formats.occurrence_lines(graph.labelled(prefix), graph.k, v), 2, 1),
            part(formats.link_lines(graph.links, graph.k, v), 2, 2),
            part(paths, 2, 3),
        ]
        return together(*rows, *([part(formats.gfa1_inputs(found), 1)] if v == 1 else []))


@register
class Gfa1(Gfa):
    name, version = "gfa1", 1


@register
class Gfa2(Gfa):
    name, version = "gfa2", 2


@register
class Fasta(Format):
    name, needs_sequences = "fasta", True

    def lines(self, graph, prefix=False):
        return part(formats.fasta_lines(graph.segments), 1)
