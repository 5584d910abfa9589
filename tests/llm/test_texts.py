"""Operators on documents against plain Python, over odd texts and rows."""

import array
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from conftest import CLEAN
from tokenizers import Tokenizer

from junctura.llm.common import Tables
from junctura.llm import mixing, packing, quality_model, quality_rules, simhash, substring_dedup

TOKENIZER = tokenizer_path("word_bpe_49k.json")


def pairs(rows):
    return [(doc, text) for doc, text, _ in rows]


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_rules_match_brute_force(odd_docs, odd_rows):
    found = quality_rules.judged(odd_docs).select("row.doc_id", "features.*", "base_failed", "kept").collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    same(got, [(doc, *brute.op2(text)) for doc, text, _ in odd_rows])
    assert not any(r.base_failed and r.kept for r in found)


def test_rules_keep_prose_and_drop_symbols(odd_docs, odd_rows):
    kept = {r.text for r in quality_rules.passing(odd_docs).select("text").collect()}
    assert CLEAN in kept and not any(t and "&&&" in t for t in kept) and None not in kept


def test_rules_filter_keeps_columns_and_takes_no_rows(odd_docs, no_docs):
    assert quality_rules.passing(odd_docs).columns == odd_docs.columns
    assert quality_rules.passing(no_docs).count() == 0


@pytest.mark.parametrize(("window", "edge"), [(50, 20), (50, 50), (6, 2), (3, 1)])
def test_repeats_match_brute_force(spark, odd_docs, odd_rows, window, edge):
    found = substring_dedup.remove_repeats(spark, odd_docs, window, edge).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same([tuple(r) for r in found], brute.op4(pairs(odd_rows), window))


@pytest.mark.parametrize(("window", "edge", "bits"), [(50, 20, 1), (6, 2, 1), (6, 6, 2), (3, 1, 4)])
def test_repeats_survive_equal_hashes(spark, odd_docs, odd_rows, window, edge, bits):
    found = substring_dedup.remove_repeats(spark, odd_docs, window, edge, bits=bits).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same([tuple(r) for r in found], brute.op4(pairs(odd_rows), window))


def test_words_that_polynomials_confuse_are_not_repeats(spark):
    twin = ["a"]
    for _ in range(10):
        twin += ["ba"["ba".index(c) - 1] for c in twin]
    word, other = "".join(twin), "".join("ab"[c == "a"] for c in twin)
    assert word != other and len(word) == 1024
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([word, *rest])), (2, " ".join([other, *rest])), (3, " ".join([word, *rest, "end"]))]
    found = substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["row"].doc_id, r.n_removed) for r in found) == [(1, 0), (2, 0), (3, 50)]


def test_repeats_cut_texts(spark, odd_docs, odd_rows, no_docs):
    found = {(r.doc_id, r.text): r for r in substring_dedup.without_repeats(spark, odd_docs).collect()}
    lost = {x[0]: x for x in brute.op4(pairs(odd_rows)) if x[2]}
    assert lost
    for (doc, text), row in found.items():
        assert row.n_chars == len(text) and row.row == "r"
        if doc not in lost:
            assert (doc, text) in pairs(odd_rows)
    # A document that loses some words keeps the others in order.
    doc = next(d for d, n, gone, _ in lost.values() if 0 < gone < n and d != 7)
    original = brute.words(dict(pairs(odd_rows))[doc])
    kept = brute.words(next(t for d, t in found if d == doc))
    assert len(kept) == lost[doc][1] - lost[doc][2] and not Counter(kept) - Counter(original)
    assert substring_dedup.without_repeats(spark, no_docs).count() == 0


def test_simhash_matches_brute_force(spark, odd_docs, odd_rows):
    for shingle, radius, levels in ((3, 2, 6), (3, 2, 1), (1, 6, 3)):
        found = simhash.near_duplicates(spark, odd_docs, shingle, radius, levels).collect()
        same([(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found], brute.op6(pairs(odd_rows), shingle, radius))


def test_simhash_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fps = np.unique(np.concatenate((base, near, np.arange(70, dtype=np.uint64))))
    tree = simhash._Tree(fps[::3], 4)
    shard, place, own = tree.route(fps, 2)
    assert Counter(place[own].tolist()) == Counter(range(len(fps)))
    links = [simhash.links_within(fps[place[(shard == s) & own]], fps[place[(shard == s) & ~own]], 2) for s in np.unique(shard)]
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 64
            parent[root(x)] = root(y)
    exact = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for i, j in zip(*np.nonzero(exact), strict=True):
        assert root(int(fps[i])) == root(int(fps[j]))
    for i in range(len(fps)):  # and no link joins what is apart
        reach, todo = {i}, [i]
        if i % 50 == 0:
            while todo:
                new = set(np.flatnonzero(exact[todo.pop()]).tolist()) - reach
                reach |= new
                todo += new
            assert {j for j in range(len(fps)) if root(int(fps[j])) == root(int(fps[i]))} == reach


def test_pieces_are_the_tokenizer_s(spark, odd_docs, odd_rows):
    found = packing.pack_documents(spark, odd_docs, TOKENIZER, capacity=64, slack=2, keep_ids=True).collect()
    tokenizer, expected = Tokenizer.from_file(TOKENIZER), []
    for doc, text, _ in odd_rows:
        ids = array.array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
        for n, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64].tobytes()
            expected.append((doc, n, start, len(part) // 4, zlib.crc32(part), part))
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found], expected)
    check_packed(found, 64)


def check_packed(found, capacity):
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_compose_before_lower_case(spark):
    texts = ["J\u030c", "xJ\u030cAZ, T\u0308. W\u030a! Y\u030a H\u0331 end", "AT\u0308 W\u0323\u030a j\u030c J\u0323\u030c", "É E\u0301É ÀB Ünï"]
    found = packing.pack_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = [(n, array.array("I", [*tokenizer.encode(t, add_special_tokens=False).ids, 0]).tobytes()) for n, t in enumerate(texts)]
    same([(r.doc_id, bytes(r.ids)) for r in found], expected)


def test_packing_merges_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 1500).tolist()
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long").repartition(6)
    found = packing.pack(spark, pieces, 100, 2).collect()
    assert sorted(r.id for r in found) == list(range(1500))
    n = check_packed(found, 100)
    assert n <= 1.03 * -(-sum(sizes) // 100) + 1


def test_packing_takes_no_rows(spark, no_docs):
    empty = spark.createDataFrame([(1, ""), (1, None)], "doc_id long, text string").coalesce(1)
    found = packing.pack_documents(spark, empty, TOKENIZER).collect()
    assert [(r.doc_id, r.length, r.ids_crc32) for r in found] == 2 * [(1, 1, zlib.crc32(bytes(4)))] and len({r.sequence_id for r in found}) == 1
    assert packing.pack_documents(spark, no_docs, TOKENIZER).count() == 0


def test_targets_share_the_excess(spark):
    def targets(sizes, weights=(1, 2, 3)):
        rows = spark.createDataFrame([(f"s{i:03}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        return [r.target for r in mixing.with_targets(Tables(spark, "test"), rows, weights).orderBy("sid").collect()]

    assert targets([100, 100, 100]) == [50, 100, 150]
    got = targets([1000, 10, 20])
    assert got[1:] == [30, 60] and got[0] == 940
    assert targets([0, 0]) == [0, 0] and targets([]) == []
    sizes = [(i * 7919) % 997 * (i % 5 + 1) for i in range(300)]
    got, weights = targets(sizes), [1 + i % 3 for i in range(300)]
    level = max(g / w for g, w in zip(got, weights, strict=True))
    assert all(abs(g - min(3 * n, w * level)) < 1e-6 for g, n, w in zip(got, sizes, weights, strict=True)) and abs(sum(got) - sum(sizes)) < 1e-6


def test_blocks_are_drawn_once_each():
    tree = mixing.SplittingTree([37, 0, 5, 120], 11, 3)
    leaves = list(tree.leaves(0, 11))
    assert [x[0] for x in leaves] == list(range(11)) and max(x[2].sum() for x in leaves) - min(x[2].sum() for x in leaves) <= 1
    assert sum(x[2] for x in leaves).tolist() == tree.quotas
    parts = [x for lo, hi in ((0, 4), (4, 5), (5, 11)) for x in tree.leaves(lo, hi)]
    assert repr(parts) == repr(leaves)


def test_large_hypergeometric_draws():
    rng, good, bad, sample = np.random.default_rng(1), 3 * 10**9, 5 * 10**9, 10**9
    found = np.array([mixing.hypergeometric(rng, good, bad, sample) for _ in range(4000)])
    share = good / (good + bad)
    sd = (sample * share * (1 - share) * (good + bad - sample) / (good + bad)) ** 0.5
    assert abs(found.mean() - sample * share) < 5 * sd / 4000**0.5 and abs(found.std() / sd - 1) < 0.06
    for g, b, n in ((10**9, 7, 10**9), (5, 10**10, 3), (10**9, 10**9, 2 * 10**9), (10**9, 0, 4)):
        assert max(0, n - b) <= mixing.hypergeometric(rng, g, b, n) <= min(g, n)


def test_the_seed_draws_the_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    first, again, other = ({r.doc_id: (r.target, r.taken) for r in mixing.taken_words(spark, docs, block_words=100, shard_words=2000, seed=s).collect()} for s in (1, 1, 2))
    assert first == again and first != other and {i: x[0] for i, x in first.items()} == {i: x[0] for i, x in other.items()}
    shards = mixing.draws(spark, docs, block_words=100, shard_words=2000).where("shard is not null").groupBy("shard").agg(F.sum("n_words").alias("n")).collect()
    assert len(shards) == 15 and max(r.n for r in shards) <= 2 * min(r.n for r in shards)


def greedy(tree):
    """Shards that take each source's ranks in turn, in place of the tree's draws."""
    sizes, leaves, at = [x[2].sum() for x in tree.leaves(0, tree.shards)], [], 0
    colours = np.repeat(np.arange(len(tree.quotas)), tree.quotas)
    ranks = np.concatenate([np.arange(q) for q in tree.quotas])
    for shard, n in enumerate(sizes):
        leaves.append((shard, colours[at : at + n].tolist(), ranks[at : at + n].tolist()))
        at += n

    def run(batches):
        import pandas as pd

        for batch in batches:
            for task in batch["id"]:
                for shard, colour, rank in leaves[16 * task : 16 * task + 16]:
                    yield pd.DataFrame({"colour": colour, "rank": rank, "shard": shard})

    return run


def test_the_tree_decides_what_a_shard_has(spark, monkeypatch):
    rows = [(i, "w " * 10, "aab"[i % 3]) for i in range(3000)]
    docs, options = spark.createDataFrame(rows, "doc_id long, text string, source string"), {"block_words": 100, "shard_words": 2000}
    held = lambda: {r.doc_id: r for r in mixing.taken_words(spark, docs, **options).collect()}
    drawn = held()
    monkeypatch.setattr(mixing, "_rank_rows", greedy)
    other = held()
    assert sum(drawn[i].shards != other[i].shards for i in drawn) > 1000 and all(drawn[i].taken == other[i].taken for i in drawn)
    # The tree gives nearly every shard words of both sources; the other split gives them to one shard of all at most.
    shares = [Counter((x.split(":")[0], rows[i][2]) for i, r in found.items() for x in r.shards.split(",") if x) for found in (drawn, other)]
    both = [sum(f[s, "a"] > 0 and f[s, "b"] > 0 for s in {k[0] for k in f}) for f in shares]
    assert both[0] >= 12 and both[1] <= 1


def test_a_shard_takes_a_run_of_one_permutation(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 10 == 0]) for i in range(2000)], "doc_id long, text string, source string")
    found = mixing.draws(spark, docs, block_words=100, shard_words=1000).where("shard is not null")
    # Of a source that is taken several times over no shard has a row twice before it has had a whole pass.
    again = found.groupBy("shard", "place").count().where("count > 1").count()
    assert found.select("copy").distinct().count() > 1 and again == 0


def test_mix_comes_near_its_targets(spark, odd_docs, odd_rows):
    options = {"block_words": 16, "shard_words": 200}
    found = mixing.taken_words(spark, odd_docs, **options).collect()
    same([(r.doc_id, r["size"]) for r in found], [(d, len(brute.words(t))) for d, t, _ in odd_rows])
    goal, taken = {}, Counter()
    for r in found:
        assert r.taken <= 3 * r["size"]
        goal[r.source_size, r.target] = r.target
        taken[r.source_size, r.target] += r.taken
    assert all(abs(taken[k] - v) <= 0.5 for k, v in goal.items())
    same(found, mixing.taken_words(spark, odd_docs.repartition(5), **options).collect())


def test_mixture_has_the_words_that_are_taken(spark, odd_docs, no_docs):
    options = {"block_words": 16, "shard_words": 200}
    mixed = mixing.mixture(spark, odd_docs, with_shard=True, **options)
    assert mixed.columns[:-1] == odd_docs.columns
    words = lambda df: sum(len(brute.words(r.text)) for r in df.select("text").collect())
    assert words(mixed) == mixing.taken_words(spark, odd_docs, **options).agg(F.sum("taken")).first()[0]
    assert mixing.mixture(spark, no_docs).count() == 0 and mixing.taken_words(spark, no_docs).count() == 0


def test_classifier_holds_out_and_scores(spark, odd_docs, odd_rows):
    good = [f"alpha beta gamma delta plain words number{i % 7} here" for i in range(60)]
    bad = [f"alpha&& beta$$ gamma** delta&& junk words number{i % 7}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    rows = quality_model.score(spark, docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert [r.doc_id for r in held] == [i for i in range(90) if zlib.crc32(str(i).encode()) % 5 == 0] and len(held) > 5
    assert all((r.score >= 0.3) == (r.doc_id < 60) for r in held)
    # Labels of what is held out are not learnt.
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_model.fit(docs, wrong).weights, model.weights)
    odd = quality_model.score(spark, odd_docs, model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    again = quality_model.load(spark, quality_model.save(spark, model))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_bigrams_are_hashed():
    a, b, c, d = quality_model.bigrams(b"one two one one".split()).tolist() + quality_model.bigrams([b"x", b"x"]).tolist()
    assert a != b and c == d and (a + b) % quality_model.BUCKETS == 0 and len(quality_model.bigrams([])) == len(quality_model.bigrams([b"x"])) == 0


def test_gradients_are_those_of_the_log_loss():
    rng = np.random.default_rng(5)
    rows, weight, layer, bias = rng.normal(size=(7, 4)), rng.random(7), rng.normal(size=(4, 2)), rng.normal(size=2)
    parts = [rows, layer, bias]

    def loss():
        z = weight @ rows @ layer + bias
        return np.log(np.exp(z).sum()) - z[1]

    for part, found in zip(parts, quality_model.gradients(rows, weight, layer, bias, 1), strict=True):
        for at in np.ndindex(part.shape):
            part[at] += 1e-6
            high = loss()
            part[at] -= 2e-6
            assert abs((high - loss()) / 2e-6 - found[at]) < 1e-6
            part[at] += 1e-6


def test_scores_match_the_whole_network(spark, odd_docs, odd_rows):
    texts = [(t or "").encode() for _, t, _ in odd_rows]
    network = quality_model.trained(texts, np.array([len(t) % 2 for t in texts]))
    expected = []
    for doc, text, _ in odd_rows:
        w = brute.words(text)
        ids = [f for x in w for f in [zlib.crc32(x.encode()) % quality_model.BUCKETS, *[zlib.crc32(f"<{x}>"[i : i + n].encode(), 1) % quality_model.BUCKETS for n in (3, 4) for i in range(len(x) + 3 - n)]]]
        ids += [zlib.crc32(b"<same>", 2) % quality_model.BUCKETS for a, b in zip(w, w[1:], strict=False) if a == b]
        z = (network.table[ids].astype(float).mean(axis=0) if ids else np.zeros(quality_model.DIM)) @ network.layer + network.bias
        expected.append((str(doc), np.exp(z[1]) / np.exp(z).sum()))
    got = [(str(r.doc_id), r.score) for r in quality_model.score(spark, odd_docs, network.model()).collect()]
    for (a, x), (b, y) in zip(sorted(expected), sorted(got), strict=True):
        assert a == b and abs(x - y) < 1e-4


def test_training_texts_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * (10 if i % 4 else 5000)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts, marks = quality_model.training_rows(docs, labels, size=4000)
    assert len(texts) == len(marks) > 100 and sum(map(len, texts)) <= 4000 and set(texts) == {b"w " * 10}
    assert len(quality_model.training_rows(docs, labels, rows=9)[0]) == 9


def test_classifier_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit(odd_docs, none)
    assert {r.score for r in quality_model.score(spark, odd_docs, model).collect()} == {0.5}
    assert quality_model.score(spark, no_docs, model).count() == 0
