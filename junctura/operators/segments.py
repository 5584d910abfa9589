"""Segments (unbranched paths) between consecutive junctions, their occurrences, links and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.functions import dna
from junctura.operators import neighbours, packed, windows
from junctura.operators.ranking import ranked
from junctura.storage import written

#: Ids of segments that begin with an indefinite letter are counted from here, in order of emission.
RESERVED = 1 << 34
MOST_ID = packed.MOST_ID
#: Letters of a tile of a sequence, and of the part that it shares with the next one: a segment of up to so many lies in one tile.
TILE, SHARED = 8192, 1024


def steps(runs: DataFrame) -> DataFrame:
    """packed.RUNS of two positions or more each: those of `runs`, and one for each two runs that follow each other, of the last and the first position.

    Their starts differ within a sequence, and are in order. `runs` is read twice: once for the ends of runs.
    """
    end = lambda i: F.struct((F.col("start") + F.get("at", i)).alias("pos"), F.get("id", i).alias("id"), F.get("sides", i).alias("sides"))
    kept = packed.names(runs)
    ends = runs.select("seq_id", *kept, end(F.lit(0)).alias("head"), end(F.size("id") - 1).alias("tail")).withColumn("pos", F.col("head.pos"))
    both = neighbours.with_next(ends, "pos", F.col("head"), "after").where("after is not null")
    gap = (F.col("after.pos") - F.col("tail.pos")).cast("int")
    across = both.select("seq_id", F.col("tail.pos").alias("start"), F.array(F.lit(0), gap).alias("at"), *[F.array(f"tail.{c}", f"after.{c}").alias(c) for c in ("id", "sides")], *kept)
    return runs.where(F.size("id") > 1).unionByName(across)


def _zipped(found: DataFrame, n: Column, **columns: tuple[str, int]) -> DataFrame:
    """seq_id, start and a row for each of `n` places of each run: a column is an array's elements from a place on."""
    parts = [F.slice(c, F.lit(first + 1), n).alias(name) for name, (c, first) in columns.items()]
    each = found.select("seq_id", "start", *parts)
    return each.select("seq_id", "start", F.inline(F.arrays_zip(*columns)))


def pairs(runs: DataFrame) -> DataFrame:
    """seq_id, begin, end, b and e (signed ids) of consecutive junctions."""
    rows = _zipped(steps(runs), F.size("id") - 1, begin=("at", 0), end=("at", 1), b=("id", 0), e=("id", 1))
    return rows.select("seq_id", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"), "b", "e")


def segment_number(b: Column, e: Column, p: Column, q: Column) -> Column:
    """The signed id of a segment; null where its letter is indefinite.

    Read from the end with the smaller id (in reading direction, if they are equal): two bits for the letter
    that follows, one for that end's sign, then its id; negative if that is against the reading direction.
    """
    straight = F.abs(b) <= F.abs(e)
    start, letter = F.when(straight, b).otherwise(-e), F.when(straight, p).otherwise(q)
    big = F.greatest(F.abs(b), F.abs(e)) >= MOST_ID
    size = F.when(big, F.raise_error(F.lit("a vertex id is too large for segment ids")).cast("long")).otherwise(F.shiftleft(F.abs(start), 3))
    number = size.bitwiseOR(F.when(start < 0, F.lit(4)).otherwise(F.lit(0)).cast("long")).bitwiseOR(dna.letter_code(letter))
    return F.when(letter != "N", F.when(start == b, number).otherwise(-number))


def reserved(found: DataFrame) -> DataFrame:
    """seq_id, start, nth, begin, end, b, e and segment_id of the pieces without a number, of packed.numbered() runs."""
    each = found.where(F.exists("segment", lambda x: x.isNull())).select("seq_id", "start", "at", "id", F.posexplode("segment").alias("nth", "segment_id")).where("segment_id is null")
    place = lambda i: (F.col("start") + F.get("at", i)).alias("begin" if i is nth else "end")
    nth = F.col("nth")
    # Written before they are ordered: bounds of ranges are sampled, and all runs are numbered once for these few pieces.
    few = written(each.select("seq_id", "start", "nth", place(nth), place(nth + 1), F.get("id", nth).alias("b"), F.get("id", nth + 1).alias("e")), "unnumbered")
    return ranked(few, ["seq_id", "begin"], "segment_id", RESERVED)


def filled(found: DataFrame, rest: DataFrame) -> DataFrame:
    """packed.numbered() runs with the reserved ids `rest` where a number is missing."""
    if rest.isEmpty():
        return found
    lacks = F.exists("segment", lambda x: x.isNull())
    known = rest.groupBy("seq_id", "start").agg(F.map_from_entries(F.collect_list(F.struct("nth", "segment_id"))).alias("ids"))
    one = F.transform("segment", lambda x, i: F.coalesce(x, F.try_element_at("ids", i)))
    return found.where(~lacks).unionByName(found.where(lacks).join(known, ["seq_id", "start"]).withColumn("segment", one).select(*found.columns))


def pieces(found: DataFrame, *kept: str) -> DataFrame:
    """seq_id, begin, end, b, e and segment_id of each two consecutive junctions, a row for each segment of runs (filled()), and the columns `kept` of runs."""
    n = F.size("segment")
    each = found.select("seq_id", "start", *kept, *[F.slice(c, F.lit(at), n).alias(name) for name, c, at in (("begin", "at", 1), ("end", "at", 2), ("b", "id", 1), ("e", "id", 2))], F.col("segment").alias("segment_id"))
    rows = each.select("seq_id", "start", *kept, F.inline(F.arrays_zip("begin", "end", "b", "e", "segment_id")))
    return rows.select("seq_id", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"), "b", "e", "segment_id", *kept)


def first_seen(found: DataFrame) -> DataFrame:
    """The first piece of each segment, by sequence and place: first of each batch of runs, then of all."""
    # The end has the number's sign, so that what is shuffled has no second number.
    piece = F.min(F.struct("seq_id", "begin", (F.col("end") * F.signum("segment_id")).cast("long").alias("end")))
    rows = packed.firsts(found).groupBy(F.abs("segment_id").alias("_abs")).agg(piece.alias("x"))
    return rows.select("x.seq_id", "x.begin", F.abs("x.end").alias("end"), F.when(F.col("x.end") < 0, -F.col("_abs")).otherwise(F.col("_abs")).alias("segment_id"))


def bodies(firsts: DataFrame, sequences: DataFrame, k: int) -> DataFrame:
    """Adds body (reverse-complemented for a negative id) and size of pieces.

    Bodies are cut from tiles of the sequences, found by sequence and place. One that is longer than tiles share is put together of several.
    """
    size = F.col("end") + k - F.col("begin")
    own = firsts.withColumn("size", size.cast("long"))
    letters = windows.tiles(sequences, TILE, SHARED).select("seq_id", "tile", F.col("letters").cast("binary").alias("letters"))
    cut = lambda start, n: F.substring("letters", (start + 1).cast("int"), n.cast("int")).cast("string")
    in_one = own.where(F.col("size") <= SHARED).withColumn("tile", F.floor(F.col("begin") / TILE))
    one = in_one.join(letters, ["seq_id", "tile"]).select(*own.columns, cut(F.col("begin") - F.col("tile") * TILE, F.col("size")).alias("read"))
    spread = own.where(F.col("size") > SHARED).withColumn("tile", F.explode(F.sequence(F.floor(F.col("begin") / TILE), F.floor((F.col("end") + k - 1) / TILE))))
    low, high = F.greatest(F.col("begin"), F.col("tile") * TILE), F.least(F.col("end") + k, (F.col("tile") + 1) * TILE)
    parts = spread.join(letters, ["seq_id", "tile"]).select(*own.columns, "tile", cut(low - F.col("tile") * TILE, high - low).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "")
    found = one.unionByName(parts.groupBy(*own.columns).agg(joined.alias("read")))
    body = F.when(F.col("segment_id") > 0, F.col("read")).otherwise(dna.reverse_complement(F.col("read")))
    return found.select(*own.columns, body.alias("body"))


def links(found: DataFrame, k: int) -> DataFrame:
    """seq_id, begin, a, a_size, b and b_size of consecutive segments of a sequence, repeats included: within runs, and from each run to the next one."""
    size = lambda low, high: (F.col(high) - F.col(low) + k).cast("long")
    rows = _zipped(found.where(F.size("segment") > 1), F.size("segment") - 1, low=("at", 0), mid=("at", 1), high=("at", 2), a=("segment", 0), b=("segment", 1))
    within = rows.select("seq_id", (F.col("start") + F.col("mid")).alias("begin"), "a", size("low", "mid").alias("a_size"), "b", size("mid", "high").alias("b_size"))
    n = F.size("segment")
    end = lambda i: F.struct((F.col("start") + F.get("at", i)).alias("begin"), F.get("segment", i).alias("segment"), (F.get("at", i + 1) - F.get("at", i) + k).cast("long").alias("size"))
    # Written, since they are read twice: runs are numbered once for them.
    ends = written(found.select("seq_id", end(F.lit(0)).alias("head"), end(n - 1).alias("tail")).withColumn("begin", F.col("head.begin")), "ends")
    both = neighbours.with_next(ends, "begin", F.col("head"), "after").where("after is not null")
    return within.unionByName(both.select("seq_id", F.col("after.begin").alias("begin"), F.col("tail.segment").alias("a"), F.col("tail.size").alias("a_size"), F.col("after.segment").alias("b"), F.col("after.size").alias("b_size")))


def paths(found: DataFrame) -> DataFrame:
    """seq_id, part and path: the signed segments of the runs that begin in each range of positions, in order; a sequence's parts, in order, are its path."""
    listed = F.array_sort(F.collect_list(F.struct("start", "segment")))
    return found.groupBy("seq_id", neighbours.span("start").alias("part")).agg(F.flatten(F.transform(listed, lambda x: x["segment"])).alias("path"))


def respelled(path_table: DataFrame, segment_table: DataFrame, k: int) -> DataFrame:
    """seq_id, start, seq and length of the pieces that each path's parts give: all but the first without the k letters that they share with the one before.

    A step takes the letters of its segment that it does not share with the step before, and a part's letters meet in one row (a long part's in several).
    A piece's start is the running sum of the lengths before it, so no row has a whole sequence. Paths are those of
    paths(), or of GFA files (part 0 alone).
    """
    # One number for a step's part and place: a part's runs begin within a range of positions, so it has fewer steps than both together.
    bits = max(neighbours.SPAN_BITS, windows.CHUNK.bit_length()) + 1
    steps = path_table.select("seq_id", F.posexplode("path").alias("nth", "segment"), "part")
    steps = steps.select("seq_id", (F.shiftleft(F.col("part").cast("long"), bits) + F.col("nth")).alias("at"), "segment")
    joined = steps.join(segment_table.select(F.abs("segment_id").alias("id"), "body"), F.abs("segment") == F.col("id"))
    read = F.when(F.col("segment") > 0, F.col("body")).otherwise(dna.reverse_complement(F.col("body")))
    # A row's first step keeps all of its letters: it may be the first of the sequence.
    first = F.col("at").bitwiseAND((1 << bits) - 1) == 0
    rows = joined.select("seq_id", "at", F.when(first, read).otherwise(F.substr(read, F.lit(k + 1))).alias("read"))
    part = F.shiftright("at", bits)
    # Dealt out as they are: an aggregation before the shuffle would find hardly two steps of a part.
    rows = rows.repartition("seq_id", part).groupBy("seq_id", part.alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "read"))), lambda x: x["read"]), "")
    texts = written(rows.agg(text.alias("seq")), "spelled")
    own = Window.partitionBy("seq_id")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = (F.length("seq") - k).cast("long").alias("n")
    # A row for each row of texts, without letters.
    sums = texts.select("seq_id", "part", n).select("seq_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"), (F.sum("n").over(own) + k).cast("long").alias("length"))
    first = F.col("low") == 0
    placed = texts.join(sums, ["seq_id", "part"])
    return placed.select("seq_id", (F.col("low") + F.when(first, 0).otherwise(k)).cast("long").alias("start"), F.when(first, F.col("seq")).otherwise(F.substr("seq", F.lit(k + 1))).alias("seq"), "length")


def overlaps(link_table: DataFrame, segment_table: DataFrame, k: int) -> DataFrame:
    """One row: the number of links, and of those whose ends differ in the k letters that they share.

    Tasks count equal links, which go to their first segment; its end then goes to the second one, once for each two segments that follow each other.
    """
    known = segment_table.select(F.abs("segment_id").alias("id"), F.substr("body", F.lit(1), F.lit(k)).alias("head"), F.right("body", F.lit(k)).alias("tail"))
    # Dealt by the first segment alone: equal links meet where its end is.
    own = packed.counted(link_table).repartition(F.abs("a")).select(F.abs("a").alias("id"), "a", "b", "n").groupBy("id", "a", "b").agg(F.sum("n").alias("n"))
    end = F.when(F.col("a") > 0, F.col("tail")).otherwise(dna.reverse_complement(F.col("head")))
    ends = own.join(known, "id").select("b", end.alias("end"), "n")
    begin = F.when(F.col("b") > 0, F.col("head")).otherwise(dna.reverse_complement(F.col("tail")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return ends.join(known, F.abs("b") == F.col("id")).agg(total("n").alias("links"), total(F.when(F.col("end") != begin, F.col("n"))).alias("violations"))
