"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

features() gives one expression for each statistic of a text; RULES is the table; compiled()
turns its rows into one boolean column and the name of the first rule that fails. The plan of a judged table is a scan
and projections: no shuffle, no Python.

The expensive statistic is the words in repeated three-word windows. Windows are compared by a 64-bit hash of
their words; only texts in which some hash occurs twice sort their windows, by the words themselves. A word is covered by the windows
that start at it or up to two words before it, so the covered words follow from the sorted starts.

Defined cases: a null text has no words and fails the base rules, as an empty one does; a text of one or two words has
no windows. All columns of the input stay, whatever their names: statistics are in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Frequent words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the be to of and that have with in is it for as was on are by this from or an at not "
    "le la les de des du et en un une que qui dans pour par sur au aux est pas avec "
    "der die das und ist in den von zu mit sich auf für nicht ein eine dem des im "
    "el la los las de que y en un una es por con para del se no su al"
).split()


@dataclass(frozen=True)
class Rule:
    """A statistic, or its ratio to another one, and the values that it may have."""

    name: str
    statistic: str
    to: str | None = None
    least: float | None = None
    most: float | None = None


#: The base rules come first; a document that fails one is not kept, whatever the others say.
BASE = (
    Rule("too_few_words", "n_words", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2, most=20),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.6),
)


def _lengths(text: Column, without: str) -> Column:
    return F.length(F.translate(text, without, "")).cast("long")


def _repeated(windows: Column, words: Column) -> Column:
    """Words covered by the windows (an array of hashes, by start) that occur more than once; equal hashes are settled by the words."""
    text = lambda at: F.concat_ws(" ", *[F.get(words, at + j) for j in range(WINDOW)])
    pairs = F.sort_array(F.transform(windows, lambda h, at: F.struct(text(at).alias("h"), at.alias("at"))))
    starts = F.transform(
        F.array(pairs),
        lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["at"])),
    )
    covered = F.transform(
        starts, lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, at: F.struct((a["n"] + F.least(F.lit(WINDOW), at - a["last"])).alias("n"), at.alias("last")))["n"]
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered[0]).otherwise(F.lit(0)).cast("long")


def with_features(docs: DataFrame, name: str = "features") -> DataFrame:
    """All rows of docs as a struct `row`, their text's statistics as a struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(row, text.alias("body"), word_array(F.col("text")).alias("words"))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    words = F.col("words")
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    hashed = cut.select("row", "body", "words", windows.alias("windows"), lines.alias("lines"))
    stop = list(dict.fromkeys(STOP_WORDS))
    n_words = F.size("words").cast("long")
    return hashed.select(
        "row",
        F.struct(
            n_words.alias("n_words"),
            _lengths(F.col("body"), " \t\n\x0b\x0c\r").alias("word_chars"),
            (F.length("body") - _lengths(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("windows"), words).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        ).alias(name),
    )


def compiled(rules: tuple[Rule, ...], features: str = "features") -> tuple[Column, Column]:
    """(passes all rules, name of the first that fails) as columns; a ratio to nothing fails."""
    fails = []
    for rule in rules:
        value = F.col(f"{features}.{rule.statistic}")
        if rule.to:
            value = F.try_divide(value, F.col(f"{features}.{rule.to}"))
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | F.coalesce(value < rule.least, F.lit(True))
        if rule.most is not None:
            bad = bad | F.coalesce(value > rule.most, F.lit(True))
        fails.append(F.when(bad, F.lit(rule.name)))
    first = F.coalesce(*fails)
    return first.isNull(), first


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """`row` (all columns of docs), `features`, base_failed, kept and failed_rule."""
    found = with_features(docs)
    base_ok, _ = compiled(base)
    kept, first = compiled(base + rules)
    return found.select("row", "features", (~base_ok).alias("base_failed"), kept.alias("kept"), first.alias("failed_rule"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The documents that pass all rules, with their own columns."""
    # A filter would be pushed below the projections, and each statistic evaluated once per rule; a generator is not.
    kept = judged(docs, rules, base).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
