"""Divergence, decontamination and the manifest against plain Python, over odd texts and rows."""

import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from junctura.llm import decontamination, divergence, manifest
from junctura.llm.common import Tables

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, own string, row string, g string, n long, item_id string, term string"


def table(spark, rows):
    """(doc_id, text, lang, source, n_chars) rows with columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, "o", "r", "g", 1, "i", "t") for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows(odd_rows):
    """Odd texts in four languages (null and empty ones, too) with few sources each, one of them hot."""
    found = [(doc, text, [None, "en", "de", "en", "", "en"][i % 6], ["a", "b", None, "a", "a"][i % 5], None if i % 11 == 3 else len(text or "")) for i, (doc, text, _) in enumerate(odd_rows)]
    return [*found, (900, "alone \x00 here", "fr", "é", 3), (901, None, "zz", "a", 0), (902, "", "zz", "b", None)]


def same(got, expected):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_divergence_matches_brute_force(spark, rows, monkeypatch):
    for held, n, top in ((1 << 24, 1 << 20, 200), (64, 8, 5)):
        monkeypatch.setattr(divergence, "HELD_BYTES", held)
        monkeypatch.setattr(divergence, "SHARD_ROWS", n)
        monkeypatch.setattr(divergence, "TOP", top)
        monkeypatch.setattr(divergence, "_TERMS", divergence._TERMS.replace("<= 200", f"<= {top}"))
        found = divergence.audited(spark, table(spark, rows).repartition(3))
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        same(found.collect(), brute.op11([(text, lang, source) for _, text, lang, source, _ in rows], top))


def test_divergence_of_few_documents(spark):
    assert divergence.audited(spark, table(spark, [])).count() == 0
    # No term is in three documents of the lang, so nothing is kept: pairs are equal, and no term stands out.
    few = [(1, "one two", "en", "a", 1), (2, "two three", "en", "b", 1), (3, None, "en", None, 1), (4, "x", None, "b", 1)]
    found = divergence.audited(spark, table(spark, few)).collect()
    same(found, brute.op11([(text, lang, source) for _, text, lang, source, _ in few], 200))
    assert {r.part for r in found} == {"pair"} and {r.value for r in found} == {0}


def test_shares_of_large_counts(spark):
    got = spark.range(1).select(divergence.share(F.lit(10**15), F.lit(3 * 10**15)), divergence.share(F.lit(10**17), F.lit(10**17 + 1))).first()
    assert tuple(got) == (1 + 10**9 * (10**15 + 1) // (3 * 10**15), 1 + 10**9)


def items():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "été", "über", "x1", "Zed", "rare" + str(rng.randrange(40))])
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 9, 10, 11, 30, 60)]
    texts += ["the the the the the the the the the the the the", "Of, THE; of", "", None, "?!", texts[7], texts[8][30:], "one-off item, with 10 words: all of them apart. Really?"]
    return [*((i, t) for i, t in enumerate(texts)), (7, texts[3]), (None, "a window without any id"), (8, texts[8])]


def suspects():
    rng = random.Random(9)
    texts = [t for _, t in items()]
    out = [*texts, *(t.upper() for t in texts if t), " ".join("the" for _ in range(300)), "a window without any id", "window without any id"]
    for t in texts:
        words = (t or "").split()
        out += [" ".join(["start", *words, "end"]), " ".join(words[1:]), " ".join(words[:12]), "/".join(words), "start\x00" + "\n".join(words) + "\x7f", " ".join(words[: len(words) // 2] + ["cut"] + words[len(words) // 2 :])]
    out += [" ".join(rng.choice(texts[8].split()) for _ in range(400)) + " " + texts[8] + " " + texts[7]]
    return list(enumerate(out)) + [(None, texts[7]), (3, texts[7]), (3, texts[7])]


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_decontamination_matches_brute_force(spark, monkeypatch, odd_rows, blocks):
    from junctura.llm import url_filter

    monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)  # with one block, the filter passes much that the join drops
    docs = [*suspects(), *((doc, text) for doc, text, _ in odd_rows)]
    benchmark = spark.createDataFrame([(i, t, 1, "w") for i, t in items()], "item_id long, text string, size long, window string")
    found = decontamination.judged(spark, table(spark, [(doc, text, "en", "a", 1) for doc, text in docs]).repartition(3), benchmark)
    expected = brute.op12(docs, items())
    same(found.collect(), expected)
    assert 20 < sum(r[-1] for r in expected) < len(expected)


def test_decontamination_of_nothing(spark):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    docs = table(spark, [(1, "some text", "en", "a", 1), (2, None, "en", "a", 1)])
    assert decontamination.judged(spark, docs.limit(0), benchmark).count() == 0
    for empty in (benchmark.limit(0), benchmark.where("text = '?!'")):
        assert sorted((r.doc_id, r.n_words, r.contaminated) for r in decontamination.judged(spark, docs, empty).collect()) == [(1, 2, False), (2, 0, False)]


def test_decontamination_runs_no_python(spark):
    benchmark = spark.createDataFrame(items(), "item_id long, text string")
    plan = decontamination.judged(spark, table(spark, [(1, "some text", "en", "a", 1)]), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def audited(spark, docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.audited(spark, docs, {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


@pytest.mark.parametrize("band", [10, 1, 2])
def test_manifest_matches_brute_force(spark, rows, monkeypatch, band):
    monkeypatch.setattr(manifest, "BAND", band)
    expected = brute.op13(rows)
    same(audited(spark, table(spark, rows).repartition(3)).collect(), expected)
    changed = {r[0] for r in expected if not r[-1]}
    assert changed and all(zlib.crc32(str(doc).encode()) % 7 == 0 for doc in changed)


def test_small_manifests(spark):
    assert audited(spark, table(spark, [])).count() == 0
    for n in (1, 2, 3, 5):
        own = [(i, "t" * i, "en", "a", i) for i in range(n)]
        same(audited(spark, table(spark, own)).collect(), brute.op13(own))
    langs = [(i, None, f"l{i:02d}", "a", i) for i in range(9)]
    same(audited(spark, table(spark, langs)).collect(), brute.op13(langs))


def test_equal_rows_are_leaves_of_their_own(spark):
    own = [(None, None, None, None, None)] * 9 + [(5, "x", "en", "a", 1)] * 3
    same(audited(spark, table(spark, own)).collect(), brute.op13(own))


def test_preimages_are_stored(spark):
    tables = Tables(spark, "test")
    leaves = table(spark, [(i, "t", "en", "a", i) for i in range(5)]).select("lang", "doc_id", manifest.leaf({c: F.col(c) for c in manifest.FIELDS}).alias("digest"))
    made = manifest.build(tables, leaves)
    (block,) = made.groups[0].collect()
    assert [len(level) for level in block.parents] == [3, 2, 1] and [len(x) for x in block.parents[0]] == [128, 128, 64]
    assert Counter(len(x) for level in block.parents for x in level) == {128: 4, 64: 2} and made.root == block.top
