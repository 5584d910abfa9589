"""Ranks over a whole table without ordering it in one task: by range partitions, which are written and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.storage import written

#: monotonically_increasing_id() counts a partition's rows from its number times 2**33.
_PART_BITS = 33


def ordered(df: DataFrame, order: list) -> DataFrame:
    """The rows as ranges of the order, each sorted: bounds are sampled, so that ranges have about as many rows, whatever the keys are."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def starts(counts: DataFrame, part: str, n: str, start: str) -> DataFrame:
    """`part` and `start`, the sum of `n` over the parts before; a row for each range, so one task sums them up."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start)))


def ranked(df: DataFrame, order: list, name: str, first: int | Column = 1) -> DataFrame:
    """Adds `name`, the row's rank under `order`, from `first`. `order` must name each row: what ties in it has its place by chance."""
    rows = written(ordered(df, order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _PART_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    joined = rows.join(starts(counts, "_part", "_n", "_start"), part == F.col("_part"))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return joined.withColumn(name, (rank + (F.lit(first) if isinstance(first, int) else first)).cast("long")).drop("_at", "_part", "_start")
