"""What follows or precedes a row of a sequence, without a task that has the whole sequence.

A sequence's rows are dealt by ranges of positions (SPAN positions each). Windows see one range; the last row of a
range has its follower in the next range that has rows, so a copy of each range's first row goes to the range before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a range, as a power of two.
SPAN_BITS = 16


def span(place: str) -> Column:
    return F.shiftright(place, SPAN_BITS)


def _exchanged(rows: DataFrame, place: str, held: Column, backwards: bool) -> DataFrame:
    """rows with `_span` and `_held`, and of each range's border row also one (`_copy`) in the nearest range that has rows on that side."""
    own = rows.withColumns({"_span": span(place), "_held": held, "_copy": F.lit(False)})
    border = F.max_by if backwards else F.min_by
    # A row for each range of positions.
    borders = own.groupBy("seq_id", "_span").agg(border("_held", place).alias("_held"), (F.max if backwards else F.min)(place).alias(place))
    order = Window.partitionBy("seq_id").orderBy("_span")
    to = (F.lead if backwards else F.lag)("_span").over(order)
    copies = borders.withColumn("_span", to).where("_span is not null").withColumn("_copy", F.lit(True))
    return own.unionByName(copies, allowMissingColumns=True)


def with_next(rows: DataFrame, place: str, held: Column, name: str) -> DataFrame:
    """Adds `name`: `held` of the row with the next place of the same sequence; null for the last one.

    `rows` (seq_id, place and more; places of a sequence differ) are read twice: once for the borders.
    """
    order = Window.partitionBy("seq_id", "_span").orderBy(place)
    found = _exchanged(rows, place, held, False).withColumn(name, F.lead("_held").over(order))
    return found.where("not _copy").drop("_span", "_held", "_copy")


def with_previous(rows: DataFrame, place: str, held: Column, name: str) -> DataFrame:
    """Adds `name`: `held` of the row with the place before in the same sequence; null for the first one."""
    order = Window.partitionBy("seq_id", "_span").orderBy(place)
    found = _exchanged(rows, place, held, True).withColumn(name, F.lag("_held").over(order))
    return found.where("not _copy").drop("_span", "_held", "_copy")


def running(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same sequence with smaller places; each range's sum is added to those after it."""
    own = rows.withColumn("_span", span(place))
    before = Window.unboundedPreceding, -1
    sums = own.groupBy("seq_id", "_span").agg(F.sum(value).alias("_sum"))
    bases = sums.select("seq_id", "_span", F.coalesce(F.sum("_sum").over(Window.partitionBy("seq_id").orderBy("_span").rowsBetween(*before)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("seq_id", "_span").orderBy(place).rowsBetween(*before)), F.lit(0))
    return own.withColumn("_within", within).join(bases, ["seq_id", "_span"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_span", "_within", "_base")
