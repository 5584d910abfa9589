"""Source divergence audit: how each source's use of terms departs from its language's and from other sources'.

Counts and pair sums are vectorized SQL that DuckDB runs within Spark's tasks, on shards; Spark deals the shards, merges what
they return and ranks it.

1. Each task counts the terms of its documents by (lang, source, term), with the number of documents, HELD_BYTES of text at a time: an
   aggregation before the shuffle.
2. Rows are dealt to shards by a hash of (lang, term), so that a shard has all counts of a term. It adds them up and keeps the terms
   that enough documents have.
3. Spark sums up each group's (lang, source) and each lang's total and number of kept terms: V terms, N occurrences. With
   these, a count is a share of PARTS parts: p = 1 + floor(PARTS * (count + 1) / (N + V)).
4. Shares of kept terms are dealt to shards by (lang, term) again. A shard takes each term's sources by twos, and sums up by pair of sources what
   differs from terms that neither or only one of the two has; of each group it returns the terms with the largest divergence from their lang.
5. Spark merges the shards' sums. Terms that only one source of a pair has need no pairing: their shares depend on its count alone, so
   a histogram of each group's counts gives their part. So no shard has a row for each term and pair of sources.

f(p, q) = floor((p - q)**2 / q). All numbers are whole: shares are decimals before their division, sums of 64 bits (of all terms of a
group, shares come to PARTS + V, so the squares of their differences stay below 2**63).

Defined cases: null text, lang or source is ''; groups without terms are compared with shares of no occurrences; a lang without kept terms has
pairs of value 0; repeated documents count each; equal values rank by item in bytewise order; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import Tables, bounded

PARTS, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes of text that a task counts at a time, and rows that it holds before it returns them.
HELD_BYTES, HELD_ROWS = 16 << 20, 1 << 20
#: Rows of counts that a shard is to hold, on average.
SHARD_ROWS = 1 << 19
_COUNTS = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long"
_SHARDED = "kind string, lang string, source string, item string, value long"

# The term rule's characters: no ASCII but letters; only A to Z are lower-cased.
_COUNT = r"""
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs
FROM (
  SELECT row, lang, source, term, count(*) AS n
  FROM (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts)
  GROUP BY ALL
) GROUP BY ALL
"""
_ADD = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
_KEEP = f"""
WITH own AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY ALL)
SELECT lang, source, term, n FROM own SEMI JOIN (SELECT lang, term FROM own GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}) USING (lang, term)
"""


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


# p is a group's share of the term, none its share of a term that it has not, whole the lang's share of the term.
_PAIRS = f"""
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item,
  sum({_f("a.p", "b.p")} - {_f("a.p", "b.none")} - {_f("a.none", "b.p")} + {_f("a.none", "b.none")})::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
_TERMS = f"""
SELECT 'term' AS kind, lang, source, term AS item, {_f("p", "whole")}::BIGINT AS value FROM shares WHERE p > whole
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP}
"""


def _sql(query: str, **tables: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(query).to_arrow_table()


def _batches(found: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from found.combine_chunks().to_batches(max_chunksize=1 << 16)


def _counted(held_bytes: int, held_rows: int):
    """Counts of a partition's texts by lang, source and term; they are added up before they are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, held, rows, row = [], 0, [], 0, 0

        def count() -> pa.Table:
            return _sql(_COUNT, texts=pa.Table.from_batches(texts))

        for batch in batches:
            first, sizes = 0, batch.column("size").to_pylist()
            for end in range(1, batch.num_rows + 1):
                size += sizes[end - 1]
                if size < held_bytes and end < batch.num_rows:
                    continue
                part = batch.slice(first, end - first)
                texts.append(part.append_column("row", pa.array(range(row, row + part.num_rows), pa.int64())))
                row, first = row + part.num_rows, end
                if size >= held_bytes:
                    held.append(count())
                    rows += held[-1].num_rows
                    texts, size = [], 0
                if rows >= held_rows:
                    held = [_sql(_ADD, counts=pa.concat_tables(held))]
                    rows = held[0].num_rows
                    if rows >= held_rows // 2:
                        yield from _batches(held[0])
                        held, rows = [], 0
        if texts:
            held.append(count())
        if held:
            yield from _batches(_sql(_ADD, counts=pa.concat_tables(held)))

    return run


def _shard(*queries: str, name: str):
    """A shard's rows go to DuckDB as they are, and the queries' rows back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for query in queries:
                yield from _batches(_sql(query, **{name: table}))

    return run


def share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / total), in decimals, since the product may exceed 64 bits."""
    product = F.lit(PARTS).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (1 + F.call_function("div", product, total.cast("decimal(19,0)"))).cast("long")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(tables: Tables, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term and n of kept terms; lang and source of every group that has documents)."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(full("lang"), full("source"), full("text"))
    counts = tables.put("counts", texts.withColumn("size", F.octet_length("text")).mapInArrow(_counted(HELD_BYTES, HELD_ROWS), _COUNTS))
    kept = counts.repartition(_shards(counts), "lang", "term").mapInArrow(_shard(_KEEP, name="counts"), _KEPT)
    return tables.put("kept", kept), tables.put("groups", texts.select("lang", "source").distinct())


def _shards(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))


def audited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group of documents."""
    tables = Tables(spark, "divergence")
    kept, groups = kept_counts(tables, docs)
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole_n"))
    langs = tables.put("langs", groups.select("lang").distinct().join(langs, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("whole_n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole_total")))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    total = F.coalesce("own_n", F.lit(0)) + F.col("v")
    # none: the share of a term that does not occur; without kept terms there are no shares, and 1 stands for them.
    none = F.when(F.col("v") == 0, F.lit(1).cast("long")).otherwise(share(F.lit(0), F.greatest(total, F.lit(1))))
    groups = tables.put("totals", groups.join(langs, "lang").join(own, ["lang", "source"], "left").select("lang", "source", "v", "whole_total", total.alias("total"), none.alias("none")))

    shares = kept.join(bounded(groups), ["lang", "source"]).select("lang", "source", "term", "n", "none", "whole_total", share(F.col("n"), F.col("total")).alias("p"))
    whole = tables.put("whole", terms.select("lang", "term", F.col("n").alias("all_n")))
    shares = shares.join(whole, ["lang", "term"]).select("lang", "source", "term", "p", "none", share(F.col("all_n"), F.col("whole_total")).alias("whole"))
    sharded = tables.put("sharded", shares.repartition(_shards(kept), "lang", "term").mapInArrow(_shard(_PAIRS, _TERMS, name="shares"), _SHARDED))

    by_count = tables.put("by-count", kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    with_share = by_count.join(bounded(groups), ["lang", "source"]).select("lang", "source", "terms", "none", share(F.col("n"), F.col("total")).alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    paired = with_share.join(other, "lang").where(F.col("source") != F.col("item"))
    missing = lambda p, q, none, other: F.sum(F.col("terms") * (_apart(p, q) - _apart(none, other))).alias("value")
    p, none, q = F.col("p"), F.col("none"), F.col("other")
    ours = paired.groupBy("lang", "source", "item").agg(missing(p, q, none, q))
    theirs = paired.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(missing(q, p, q, none))
    base = groups.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("v") * _apart(none, q)).alias("value"))
    both = sharded.where("kind = 'pair'").select("lang", "source", "item", "value")
    pairs = base.unionByName(ours).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda found, part: found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    # What is filtered by rank is cut to TOP rows of a group before it is shuffled.
    most = ranked(sharded.where("kind = 'term'"), "term").where(F.col("rank") <= TOP)
    return ranked(pairs, "pair").unionByName(most)
