"""A Merkle manifest of a table: parents keep their preimages, and leaves prove themselves by joining them.

A leaf is the SHA-256 of a row's fields, each with its length. Within a group (a lang) leaves ascend by doc_id, and every
FANOUT consecutive nodes of a level become their parent, until one is left, the subroot; subroots, in order of
their groups, become the root likewise. A parent's preimage is the concatenation of its children's hashes (DIGEST characters
each), and the manifest stores preimages, not siblings: a node's siblings are its parent's preimage with its own slot cut
out, and a changed node's parent is the hash of the preimage with the slot replaced.

Trees are built by blocks of FANOUT**BAND consecutive nodes, which one row holds with all its parents' preimages; the
blocks' tops are the nodes of the next band. So a hot group is many blocks, a block has a bounded size,
and a billion leaves take three bands. Going down, each block gets the preimages above it
by one join, so that leaves meet their ancestors by block and are never copied once per level.

Defined cases: a null field is "-"; leaves without a doc_id come first, rows that repeat a doc_id are leaves of their own, in order of their
hashes; a group's null stands before all others; an empty table has no rows and no root; extra columns are not hashed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import Tables, bounded, numbered

#: Children of a parent; levels that one block of nodes climbs; characters of a digest.
FANOUT, BAND, DIGEST = 2, 10, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:int>>"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(row: dict[str, Column]) -> Column:
    """The hash of FIELDS, whose columns `row` gives."""
    sized = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return hashed(F.concat(*[sized(row[name].cast("string")) for name in FIELDS]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _preimages(nodes: Column) -> Column:
    """Each FANOUT consecutive digests of an array (the last: fewer), joined."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT)), lambda p: F.array_join(F.slice(nodes, p, F.lit(FANOUT)), ""))


def parents(digests: Column, levels: Column) -> Column:
    """The preimages of all parents of an array of digests, by level from the lowest, `levels` levels up."""
    above = lambda held: F.when(F.size(held) == 0, digests).otherwise(F.transform(F.get(held, F.size(held) - 1), hashed))
    grown = F.aggregate(
        F.array_repeat(F.lit(0), levels), F.array().cast("array<array<string>>"),
        lambda held, _: F.concat(held, F.array(_let(above(held), _preimages))).cast("array<array<string>>"),
    )
    return grown


def path(preimages: Column, place: Column) -> Column:
    """The preimages of the ancestors of the node at a place of its block, each with the slot that the path takes."""
    at = lambda level: F.floor(place / F.pow(F.lit(FANOUT), level)).cast("int")
    return F.transform(preimages, lambda level, n: F.struct(F.get(level, at(n + 1)).alias("preimage"), (at(n) % FANOUT).alias("slot")))


def siblings(step: Column) -> Column:
    """A step's preimage without the path's own slot: the hashes of the siblings."""
    return F.overlay(step["preimage"], F.lit(""), step["slot"] * DIGEST + 1, F.lit(DIGEST))


def folded(digest: Column, steps: Column) -> Column:
    """The root that follows from a node's hash: each preimage takes it in the path's slot and is hashed."""
    return F.aggregate(steps, digest, lambda own, step: hashed(F.overlay(step["preimage"], own, step["slot"] * DIGEST + 1)))


def proof(steps: Column) -> Column:
    """The hash of all siblings, from the lowest level up."""
    return hashed(F.array_join(F.transform(steps, siblings), ""))


def _band(nodes: DataFrame) -> DataFrame:
    """Blocks (g, block, n, nodes, parents and top) of the nodes (g, at, digest, n) of trees that have n nodes on this level."""
    size = FANOUT**BAND
    extra = [c for c in nodes.columns if c not in ("g", "at", "n")]
    held = F.array_sort(F.collect_list(F.struct("at", *extra))).alias("nodes")
    block = F.floor(F.col("at") / size).cast("long").alias("block")
    rows = nodes.groupBy("g", block, "n").agg(held)
    # A tree of this block alone climbs until one node is left.
    levels = F.size(F.filter(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(BAND)]), lambda held: held < F.col("n")))
    rows = rows.withColumn("parents", parents(F.transform("nodes", lambda x: x["digest"]), levels))
    top = F.when(F.size("parents") == 0, F.get("nodes", F.lit(0))["digest"]).otherwise(hashed(F.get(F.get("parents", F.size("parents") - 1), F.lit(0))))
    return rows.withColumn("top", top)


def climb(tables: Tables, name: str, nodes: DataFrame) -> list[DataFrame]:
    """The bands of all trees of nodes (g, at from 0, digest, n of the tree, any more), from the lowest up."""
    most, bands = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        bands.append(tables.put(f"{name}{len(bands)}", _band(nodes)))
        if most <= FANOUT**BAND:
            return bands
        above = F.ceil(F.col("n") / FANOUT**BAND).cast("long")
        nodes = bands[-1].select("g", F.col("block").alias("at"), F.col("top").alias("digest"), above.alias("n"))
        most = -(-most // FANOUT**BAND)


def descend(tables: Tables, name: str, bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest band's blocks, each with `steps`, the path from its top to the root, and the further columns of `above` (g, block 0, steps)."""
    for at in range(len(bands) - 1, 0, -1):
        rows = bands[at].join(above, ["g", "block"])
        others = [c for c in above.columns if c not in ("g", "block", "steps")]
        place = F.pmod(F.col("node")["at"], F.lit(FANOUT**BAND)).cast("int")
        down = rows.select("g", *others, "parents", "steps", F.explode("nodes").alias("node"))
        down = down.select("g", F.col("node")["at"].alias("block"), F.concat(path(F.col("parents"), place), F.col("steps")).cast(_PATH).alias("steps"), *others)
        above = tables.put(f"{name}-down{at}", down)
    return bands[0].join(above, ["g", "block"])


@dataclass
class Manifest:
    """Preimage tables of the groups' trees and of the tree of their subroots, and the root (None of an empty table)."""

    groups: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def build(tables: Tables, leaves: DataFrame) -> Manifest:
    """The manifest of leaves (lang, doc_id, digest, any more): the order of rows that are equal in these three decides nothing."""
    keyed = leaves.withColumn("g", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")))
    # A salt deals equal rows, however many, over several ranges.
    placed = numbered(tables, "leaves", keyed.withColumn("salt", F.rand(7)), ["g", F.asc_nulls_first("doc_id"), "digest", "salt"], "place")
    starts = tables.put("starts", placed.groupBy(F.col("g").alias("_g")).agg(F.min("place").alias("_start"), F.count("*").alias("n")))
    extra = [c for c in leaves.columns if c not in ("lang", "digest")]
    nodes = placed.join(bounded(starts), F.col("g") == F.col("_g")).select("g", (F.col("place") - F.col("_start")).alias("at"), "digest", "n", *extra)
    groups = climb(tables, "groups", nodes)
    subroots = numbered(tables, "subroots", groups[-1].select(F.col("g").alias("of"), F.col("top").alias("digest")), ["of"], "at")
    count = starts.count()
    tops = climb(tables, "tops", subroots.select(F.lit("").alias("g"), "at", "digest", F.lit(count).cast("long").alias("n"), "of"))
    found = tops[-1].select("top").first()
    return Manifest(groups, tops, found[0] if found else None)


def proven(tables: Tables, made: Manifest) -> DataFrame:
    """Blocks of leaves (nodes, parents) with `steps`, the path above them up to the root, and their group's subroot."""
    start = made.tops[-1].select("g", "block", F.array().cast(_PATH).alias("steps"))
    langs = descend(tables, "tops", made.tops, start).select("parents", "steps", F.explode("nodes").alias("node"))
    place = F.pmod(F.col("node")["at"], F.lit(FANOUT**BAND)).cast("int")
    above = langs.select(F.col("node")["of"].alias("g"), F.lit(0).cast("long").alias("block"), F.concat(path(F.col("parents"), place), F.col("steps")).cast(_PATH).alias("steps"), F.col("node")["digest"].alias("subroot"))
    return descend(tables, "groups", made.groups, tables.put("langs", above))


def audited(spark: SparkSession, docs: DataFrame, altered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    `altered` gives columns in place of some fields: the rows as they are found now. folded_root is what their leaves and
    the manifest's preimages give; rows whose fields changed do not fold to the root.
    """
    tables = Tables(spark, "manifest")
    fields = {name: F.col(name) for name in FIELDS}
    leaves = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), leaf(fields | (altered or {})).alias("now"))
    made = build(tables, leaves)
    own = lambda n: F.concat(path(F.col("parents"), n), F.col("steps")).cast(_PATH)
    result = F.transform("nodes", lambda x, n: _let(own(n), lambda steps: F.struct(
        x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), F.col("subroot").alias("subroot"), proof(steps).alias("proof_sha256"), folded(x["now"], steps).alias("folded_root"),
    )))
    rows = proven(tables, made).select(F.inline(result))
    root = F.lit(made.root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
