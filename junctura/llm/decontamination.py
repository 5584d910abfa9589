"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

A window is WINDOW consecutive words of an item (all words of an item that has fewer); it is in a document where the
document has the same words in the same order. Windows are sets of shingles, SHINGLE words each at a place of the window, and
the document holds a window where it holds all of its shingles in place: containment 1, so that the prefix that must be
joined is one shingle, the rarest of the window by its count over all documents.

1. Documents are cut into words once, and a row is made of each place whose shingle may be one of the benchmark's, by a blocked
   Bloom filter of bounded size, and one of each document. That table is written; nothing else reads texts.
2. Possible shingles are joined to the benchmark's, and false positives go. What is left is counted by shingle.
3. Each window is keyed by its rarest shingle; one that does not occur anywhere makes its windows drop out.
4. Occurrences meet the windows of their key only. By position and length, a window that would begin before the document or end after
   it is dropped; by containment, one whose shingles are not those around the occurrence, in a span of one window.
5. Spans are united by document, and their items gathered.

All of it is DataFrame functions. A place of a document has one shingle, so rows of step 2 are at most as many as
words; a span is compared with the words of one window, however long the text.

Defined cases: null texts and texts without words have none; an item without words has no window; items are told apart by item_id, so repeated item rows are
one item, and windows of an item without an id are hits but no item; repeated documents are judged each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.llm.common import Tables, bounded
from junctura.llm.url_filter import bloom_filter, possible

WINDOW, SHINGLE = 10, 3
# The word rule's separators, all ASCII characters but digits and letters, and the letters' cases.
_LETTERS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum())


def words(text: Column) -> Column:
    """The words of a text, lower-cased from A to Z: runs of characters that are no ASCII but digits and letters."""
    # translate() takes no NUL, which is a separator too.
    flat = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" ")), _LETTERS + _APART, _SMALL + " " * len(_APART))
    return F.array_remove(F.split(flat, " "), "")


def _shingle(own: Column, at: Column, width: Column) -> Column:
    return F.array_join(F.slice(own, at + 1, width), " ")


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (its words, joined), size, width of its shingles, and shingles in order, of every window of every item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("own")).where(F.size("own") > 0)
    size = F.least(F.size("own"), F.lit(WINDOW))
    rows = rows.select("item_id", "own", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("own") - size)).alias("at"))
    width = F.least("size", F.lit(SHINGLE)).alias("width")
    rows = rows.select("item_id", F.slice("own", F.col("at") + 1, F.col("size")).alias("own"), "size", width)
    parts = F.transform(F.sequence(F.lit(0), F.col("size") - F.col("width")), lambda i: _shingle(F.col("own"), i, F.col("width")))
    return rows.select("item_id", F.array_join("own", " ").alias("window"), "size", "width", parts.alias("shingles")).distinct()


def _key(parts: list[Column], width: Column) -> Column:
    """64 bits of a shingle, from its words without joining them; what has equal bits is compared later."""
    return F.xxhash64(width, *[F.when(width > i, part) for i, part in enumerate(parts)])


def places(spark: SparkSession, docs: DataFrame, listed: DataFrame, widths: list[int]) -> DataFrame:
    """row, doc_id, n_words, width, pos and shingle of places that may have a listed shingle (width, shingle); of each row also one with pos -1."""
    apart = F.split("shingle", " ")
    keys = listed.select(_key([F.get(apart, F.lit(i)) for i in range(SHINGLE)], F.col("width")).alias("key"))
    filter_row, blocks = bloom_filter(spark, keys, keys.count())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("own"))
    rows = rows.select("row", "doc_id", "own", F.size("own").cast("long").alias("n_words"))
    # Places are exploded beside the words, not with them: generated code reads words by number, and only what passes becomes a row.
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), F.size("own") - 1)).alias("pos"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, widths or [SHINGLE]))).alias("width"))
    here = _key([F.get("own", F.col("pos") + i) for i in range(SHINGLE)], F.col("width"))
    inside = (F.col("pos") >= 0) & (F.col("pos") + F.col("width") <= F.col("n_words")) & possible(here, filter_row, blocks)
    first = (F.col("pos") == -1) & (F.col("width") == (widths or [SHINGLE])[0])
    return rows.where(first | inside).select("row", "doc_id", "n_words", "width", "pos", F.when(F.col("pos") >= 0, _shingle(F.col("own"), F.col("pos"), F.col("width"))).alias("shingle"))


def occurring(tables: Tables, found: DataFrame, listed: DataFrame) -> DataFrame:
    """row, window and start of every occurrence of a window (window, size, width, shingles); found has the places of its shingles."""
    counts = found.groupBy("width", "shingle").agg(F.count("*").alias("n"))
    parts = listed.select("window", "width", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = parts.join(counts, ["width", "shingle"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window").agg(F.min(F.struct("n", "shingle", "offset")).alias("rarest"))
    keyed = listed.join(rarest, "window").where("rarest.n > 0").select("window", "size", "width", "shingles", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    keyed = tables.put("keyed", keyed)
    near = Window.partitionBy("row", "width").orderBy("pos").rangeBetween(1 - WINDOW, WINDOW - 1)
    around = found.withColumn("around", F.collect_list(F.struct("pos", "shingle")).over(near))
    start = F.col("pos") - F.col("offset")
    met = around.join(bounded(keyed), ["width", "shingle"]).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    span = F.filter("around", lambda x: x["pos"].between(start, start + F.col("size") - F.col("width")))
    return met.where(F.transform(span, lambda x: x["shingle"]) == F.col("shingles")).select("row", "window", start.alias("start"), "size")


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    tables = Tables(spark, "decontamination")
    items = tables.put("windows", windows(benchmark))
    listed = tables.put("listed", items.select("window", "size", "width", "shingles").distinct())
    shingles = tables.put("shingles", listed.select("width", F.explode("shingles").alias("shingle")).distinct())
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # SHINGLE of them at most
    seen = tables.put("places", places(spark, docs, shingles, widths))
    found = tables.put("found", seen.where("pos >= 0").join(bounded(shingles), ["width", "shingle"]))
    hits = tables.put("hits", occurring(tables, found, listed))
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    n_hit = spans.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    of = hits.select("row", "window").distinct().join(items.select("window", "item_id"), "window").select("row", "item_id").distinct()
    named = of.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = seen.where("pos = -1").select("row", "doc_id", "n_words").join(n_hit.join(named, "row"), "row", "left")
    own = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
