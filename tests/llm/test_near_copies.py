"""The pipeline's near-duplicates against plain Python: five words, a Jaccard index of 0.8."""

import random
import sys
from collections import Counter
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from conftest import documents  # noqa: E402
from junctura.llm import near_copies, simhash  # noqa: E402
from junctura.llm.common import Tables  # noqa: E402


def shingles(text, n=5):
    w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts):
    """The group of each text, by comparing all pairs."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def expected(rows):
    first = {}
    for (doc, _, _), g in zip(rows, groups([t for _, t, _ in rows]), strict=True):
        first[g] = min((x for x in (doc, first.get(g)) if x is not None), default=None)
    return Counter(first.values())


def near_rows():
    """Copies with 1 to 30 of 150 words changed, chains of copies of copies, and a passage that many unlike texts share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts, passage = [], [word() for _ in range(120)]
    for _ in range(6):
        base = [word() for _ in range(150)]
        for changed in (0, 1, 2, 3, 3, 4, 5, 7, 10, 30):
            copy = base[:]
            for at in rng.sample(range(150), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
        for _ in range(4):
            base[rng.randrange(150)], base[rng.randrange(150)] = word(), word()
            texts.append(" ".join(base))
    texts += [" ".join(passage + [word() for _ in range(n)]) for n in (20, 20, 25, 28, 30, 35, 60, 90)]
    rng.shuffle(texts)
    return [(i, t, "a") for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [256, 5])
def test_near_dedup_matches_brute_force(spark, odd_rows, no_docs, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "HUBS", 2)
    rows = near_rows()
    for found in (rows, odd_rows):
        kept = corpus_pipeline.near_dedup(spark, documents(spark, found).repartition(3), "").collect()
        assert Counter(r.doc_id for r in kept) == expected(found)
    assert set(expected(rows)) != {c for _, _, c in brute.op6([(i, t) for i, t, _ in rows])}
    assert corpus_pipeline.near_dedup(spark, no_docs, "").columns == no_docs.columns
    assert corpus_pipeline.near_dedup(spark, no_docs, "").count() == 0


def test_rows_that_repeat_leave_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a, "s"), (7, a, "s"), (7, b, "s"), (3, b, "s"), (None, a, "s"), (None, c, "s")]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("7", a), ("3", b), ("None", c)])


@pytest.mark.parametrize("n", [0, 1, 60])
def test_components_by_rounds_and_in_one_task(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(n)] + [(-1000 - i, -1001 - i) for i in range(n)]
    expected = {}
    for a, b in links:
        if a != b:
            both = expected.get(a, {a}) | expected.get(b, {b})
            expected.update(dict.fromkeys(both, both))
    expected = sorted((x, min(group)) for x, group in expected.items())
    for last in (0, 40, simhash.LAST_LINKS):
        found = simhash.components(Tables(spark, "test"), spark.createDataFrame(links, "a long, b long"), last)
        assert sorted(map(tuple, found.collect())) == expected


def test_words_that_polynomials_confuse_are_no_copies(spark):
    twin = ["a"]
    for _ in range(10):
        twin += ["ba"["ba".index(c) - 1] for c in twin]
    one = "".join(twin)
    other = "".join("ab"[c == "a"] for c in one)
    texts = [" ".join(w[i:] + w[:i] for i in range(60)) for w in (one, other)]
    assert not set(texts[0].split()) & set(texts[1].split())
    kept = near_copies.one_of_each(spark, documents(spark, [(1, texts[0], "a"), (2, texts[1], "a"), (3, texts[1] + " end", "a")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
