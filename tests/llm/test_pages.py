"""Operators on pages and vectors."""

import gzip
import hashlib
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm.common import Tables
from junctura.llm import html_text, queries, topk, url_filter, warc

PAGE = """<!doctype html><head><title>x</title><body><nav><ul><li>a<li>b<ul><li>c</ul></ul></nav><h1>Head &amp; x</h1>
<p>one <b>two<p>three<br>four <span hidden>no</span><span style="display: none">no</span>  <i>five</i>.<ol start=3><li>x<li>y</ol>
<table><tr><th>Name<th>Value<tr><td>a long cell<td>1</table>after<pre>  keep
   this</pre>text <script>var t="</p>";</script>end<a href="x>y">link</a>"""
TEXT = """- a
- b
  - c

Head & x

one two

three
four five.

3. x
4. y

Name         Value
a long cell  1

after

  keep
   this

text endlink"""


def test_page_layout():
    assert html_text.visible_text(PAGE) == TEXT


def test_visibility_and_implied_tags():
    see = html_text.visible_text
    assert see("<style>p{}</style>a<template>b</template><noscript>c</noscript><p style='visibility:hidden'>d</p>e") == "a\ne"
    assert see("<div>a</div>b<div>c") == "a\nb\nc"
    assert see("<p>a<div>b</div></p>c") == "a\n\nb\n\nc"
    assert see("<dl><dt>k<dd>v<dt>l</dl>") == "k\nv\nl"
    assert see("a<!-- b -->c<!-- d") == "ac" and see("x < y <3 &lt;z&gt; &nbsp;") == "x < y <3 <z> \xa0"
    assert see("<table><tr><td>a<table><tr><td>1<td>2</table><td>b</table>") == "a     b\n1  2"
    assert see(None) == see("") == see("<script>") == ""


def test_references_of_any_length():
    see = html_text.visible_text
    for digits in ("9" * 5000, "0" * 5000 + "12345678", "x" + "f" * 9000):
        assert see(f"a&#{digits};b<p title='&#{digits}'>c<textarea>&#{digits};d</textarea>") == "a\ufffdb\n\nc\ufffdd"
    assert see("&#" + "0" * 5000 + "65;&#x" + "0" * 5000 + "42 &#00000038;amp; &#0000000000") == "AB &amp; \ufffd"


def seconds(page):
    began = time.process_time()
    text = html_text.visible_text(page)
    assert len(text) <= 64 * len(page)
    return time.process_time() - began


BROKEN = ["<div>", '<a href="', "<!--", "<p ", "</b>", "<b", "<table><tr><td>", "<table><tr><td>x", "<ul><li>x", "<b><p>x", "<td>x<td>y<br>", "<select><option>", "<dl><dt>a<dd>b", "</p>", "<i></td>"]


@pytest.mark.parametrize("part", BROKEN)
def test_long_and_broken_pages_take_linear_time(part):
    for before in ("", "<p><button>", "<head><b>", "<table><tr><td>"):
        assert seconds(before + part * 8000) < 0.2 + 8 * max(0.05, seconds(before + part * 2000))


def test_wide_cells_do_not_widen_the_table():
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>a" + "<tr><td>x<td>y" * 2000 + "</table>"
    text = html_text.visible_text(wide)
    assert len(text) < 4 * len(wide) and text.split("\n")[:3] == ["w" * 20_000, "a", "x  y"]
    tall = "<table><tr><td>" + "l<br>" * 3000 + "<td>c" * 3000 + "</table>"
    assert len(html_text.visible_text(tall)) < 4 * len(tall)
    assert html_text.visible_text("<table><tr><td>" + "w" * 61 + "<td>b<td>c<tr><td>d<td>e</table>") == "w" * 61 + "\nb  c\nd  e"


def test_head_ends_and_drawings_have_text():
    see = html_text.visible_text
    assert see("<head><title>t</title> <a>one</a><p>two") == "one\n\ntwo" and see("<head>one<div>two") == "one\ntwo"
    assert see("<head><meta><style>x</style><b>bold</b> text") == "bold text"
    assert see("<svg><title>t</title><desc>no</desc><text>yes</text></svg><math><mi>x</mi></math>") == "yesx"


def random_page(rng, depth=0):
    """(html, visible words in order) of a random tree; end tags that are implied are left out at random."""
    html, words = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["word", "word", "inline", "block", "list", "table", "hidden", "comment"])
        if kind == "word" or depth > 3:
            w = "".join(rng.choice("abcdefgh") for _ in range(6))
            html.append(f" {w} ")
            words.append(w)
            continue
        inner, own = random_page(rng, depth + 1)
        if kind == "inline":
            tag = rng.choice(["b", "span", "a", "em"])
            inner, own = " ".join(own), own
            html.append(f" <{tag}>{inner}</{tag}> ")
        elif kind == "block":
            tag = rng.choice(["div", "section", "blockquote", "pre"])
            html.append(f"<{tag}>{inner}</{tag}>")
        elif kind == "list":
            more, other = random_page(rng, depth + 1)
            end = rng.choice(["", "</li>"])
            html.append(f"<ul><li>{inner}{end}<li>{more}{end}</ul>")
            own = own + other
        elif kind == "table":
            cell = lambda: rng.choice(["ab", "cd", "ef"])
            own = [cell() for _ in range(4)]
            html.append("<table><tr><td>{}<td>{}{}<tr><td>{}<td>{}</table>".format(own[0], own[1], rng.choice(["", "</tr>"]), own[2], own[3]))
        elif kind == "hidden":
            html.append(rng.choice(["<div hidden>{}</div>", "<p style='display:none'>x {}</p>", "<template>{}</template>"]).format(" ".join(own)))
            own = []
        else:
            html.append("<!-- " + " ".join(own) + " -->")
            own = []
        words += own
    return "".join(html), words


def test_visible_words_of_random_pages():
    rng = random.Random(11)
    for _ in range(400):
        html, words = random_page(rng)
        assert [w for w in html_text.visible_text(html).split() if w != "-"] == words, html


def test_extraction_table(spark):
    rows = [(1, PAGE, "t"), (1, PAGE, "t"), (None, None, None), (2, "", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extracted(pages).collect()
    assert sorted(map(repr, ((r.page_id, r.text, r.n_lines) for r in got))) == sorted(map(repr, [(1, TEXT, TEXT.count("\n") + 1), (1, TEXT, TEXT.count("\n") + 1), (None, "", 0), (2, "", 0)]))
    assert html_text.extracted(pages.limit(0)).count() == 0


URLS = [
    "http://a.example.com/en/5", "https://EXAMPLE.com/en/77?x", "http://notexample.com/en/7", "http://com/en/", "http://com/en", "x.com/en/1", None, "",
    "http://b.net/de/1#f", "http://example.net/de/8", "http://x.example.net/de/81/", "http://org", "http://w.org?/es/", "http://w.org/es/://com/en/", "ftp://org/es/ñ",
    "http://./en/", "http://", "://com/en/x", "http://example.com./en/7", "http://a.example.com/EN/7",
]


def test_url_rules_match_brute_force(spark):
    urls = [*URLS, *URLS[:3], "http://" + "a." * 3000 + "com/en/" + "y" * 20_000]
    pages = spark.createDataFrame([(i % 21, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.judged(spark, pages, url_filter.rules(spark, queries.URL_RULES)).collect()
    expected = [(i % 21, *brute.op8(u, queries.URL_RULES)) for i, u in enumerate(urls)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert url_filter.judged(spark, pages.limit(0), url_filter.rules(spark, queries.URL_RULES)).count() == 0


def test_url_filter_without_rules_and_false_positives(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = url_filter.rules(spark, queries.URL_RULES).limit(0)
    assert [tuple(r) for r in url_filter.judged(spark, pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    # A filter of one block passes nearly everything; the join stays exact.
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rules = [("block", f"h{i}.org", f"/p{i % 9}") for i in range(200)]
    urls = [f"http://www.h{i}.org/p{i % 8}/x" for i in range(250)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(spark, pages, url_filter.rules(spark, rules)).collect()}
    assert got == {i: brute.op8(u, rules) for i, u in enumerate(urls)}


def test_url_rules_of_all_lengths(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "bb", "c", "", "example"]) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(["x", "yy", "z", ""]) for _ in range(rng.randint(0, 4)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(150)]
    urls = ["http://" + host() + "/" + path() + rng.choice(["", "?q", "#f"]) for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judged(spark, pages, url_filter.rules(spark, rules)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(i, *brute.op8(u, rules)) for i, u in enumerate(urls)]))


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = {int(i): rng.normal(size=6).round(1).tolist() for i in rng.permutation(700)}
    vectors |= {i: [0.5] * 6 for i in range(100, 160)} | {900: [0.0] * 6, 950: [1.0] * 6}
    rows = [(i, v) for i, v in vectors.items()] + [(None, [0.0] * 6), (1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [1.0, 2.0])]
    repeated = [(1, [9.0] * 6), (1, [9.0] * 6), (7, [-9.0] * 6), (150, [0.5] * 6)]
    rows += repeated
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    units = table.where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_units(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(spark, units, units.where("vec_id % 50 = 0"), shard_rows=100).collect())
    kept = sorted([*vectors.items(), *repeated])
    ids = np.array([i for i, _ in kept])
    matrix = np.floor(256 * np.array([v for _, v in kept], np.float32).astype(float))
    expected = []
    for i in np.unique(ids[ids % 50 == 0]):
        scores = matrix @ matrix[ids == i][0]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:5]
        expected += [(int(i), n, int(ids[j]), int(scores[j])) for n, j in enumerate(best, 1)]
    assert got == sorted(expected)
    assert topk.top_k(spark, units.limit(0), units.limit(0)).count() == 0
    few = units.where("vec_id in (0, 2, 3)")
    assert topk.top_k(spark, few, few.where("vec_id = 0")).count() == 2


def records(spark, n=400):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 50)}{i}</p>", "f") for i in range(n)] + [(5, "http://h/5", "<p>again</p>", "f"), (None, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string")


def test_audit_finds_every_damage(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1024)
    primary = warc.archive(records(spark), Tables(spark, "test"), file_bytes=20_000).cache()
    assert warc.audit(spark, primary, primary).count() == 0
    first = primary.orderBy("file", "record_offset").collect()
    for r, s in zip(first, first[1:], strict=False):
        assert s.record_offset == (r.record_offset + r.record_length if r.file == s.file else 0)
    changed = primary.withColumn("record_sha256", F.when(F.col("page_id") % 97 == 3, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("record_sha256"))).where("page_id is null or page_id % 89 <> 4")
    extra = changed.limit(1).withColumns({"record_offset": F.lit(10_000_000).cast("long"), "record_id": F.lit("other")})
    found = warc.audit(spark, primary, changed.unionByName(extra)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in found} == {"altered": 5, "lost": 5, "extra": 1}
    status = {r.page_id: r.status for r in warc.checked(spark, primary, changed).collect()}
    assert status[3] == "altered" and status[93] == "lost" and status[None] == "intact"
    assert warc.checked(spark, primary.limit(0), primary.limit(0)).count() == 0


def test_records_are_read_back(spark, tmp_path):
    pages = records(spark, 20)
    bodies = [r.b for r in pages.orderBy("page_id", "html").select(warc.record(F.col("url"), F.col("html")).alias("b")).collect()]
    (tmp_path / "a.warc").write_bytes("".join(bodies).encode())
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b.encode()) for b in bodies))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(bodies) and {r.uri for r in got} == {f"http://h/{i}" for i in range(20)} | {""}
    archived = {r.record_sha256 for r in warc.archive(pages, Tables(spark, "test")).collect()}
    content = "".join(bodies).encode()
    assert {hashlib.sha256(content[r.record_offset : r.record_offset + r.record_length]).hexdigest() for r in got} == archived


def test_damaged_files_are_read_on(spark, tmp_path):
    bodies = [r.b.encode() for r in records(spark, 30).orderBy("page_id", "html").select(warc.record(F.col("url"), F.col("html")).alias("b")).collect()]
    whole = [x[1:] for x in warc.parsed(b"".join(bodies))]
    assert len(whole) == len(bodies) and sum(x[1] for x in whole) == sum(map(len, bodies))
    bad = [b"xx" + bodies[0], bodies[1].replace(b"Content-Length: ", b"Content-Length: -"), bodies[2][:-9], bodies[3].replace(b"resource", b"\xff\xfe"), *bodies[4:]]
    found = list(warc.parsed(b"".join(bad)))
    assert [f[4] for f in found].count("damage") == 3 and len({f[3] for f in found} & {x[2] for x in whole}) == len(bodies) - 3
    assert b"".join(b"".join(bad)[f[1] : f[1] + f[2]] for f in found) == b"".join(bad)
    packed = [gzip.compress(x) for x in bodies]
    cut = b"".join([packed[0], packed[1][:20], *packed[2:-1], packed[-1][:-12]])
    assert len(list(warc.parsed(warc.unpacked(cut)))) >= len(bodies) - 2
    rng = np.random.default_rng(3)
    for n in range(200):
        junk = bytearray(b"".join(bodies[:4]) if n % 2 else b"".join(packed[:4]))
        for at in rng.integers(0, len(junk), 5):
            junk[at] = rng.integers(256)
        list(warc.parsed(warc.unpacked(bytes(junk[: rng.integers(len(junk))]))))


def test_files_of_any_shape_are_read_in_linear_time():
    member = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + bytes(range(256)) * 6)
    for data in (member * 8000, b"WARC/1.0\r\n" * 100_000, b"WARC/1.0\r\n" * 100_000 + b"\r\n\r\n", b"X: WARC/1.1\r\n" * 80_000, b"WARC/1.0\r\nContent-Length: 9\r\n\r\n" * 30_000):
        began = time.perf_counter()
        whole = warc.unpacked(data)
        found = list(warc.parsed(whole))
        assert time.perf_counter() - began < 3 and sum(f[2] for f in found) == len(whole)


def test_files_are_audited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 1024)
    bodies = [r.b.encode() for r in records(spark, 60).orderBy("page_id", "html").select(warc.record(F.col("url"), F.col("html")).alias("b")).collect()]
    for name, content in (("a", bodies), ("b", [*bodies[:20], *bodies[21:40], bodies[40].replace(b"<p>", b"<q>"), *bodies[41:]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.warc.gz").write_bytes(b"".join(map(gzip.compress, bodies)))
        (tmp_path / name / "1.warc").write_bytes(b"".join(content))
    primary, replica = (warc.inventory(spark, str(tmp_path / name)).cache() for name in "ab")
    at = [sum(map(len, bodies[:n])) for n in (20, 40)]
    assert sorted(map(tuple, warc.audit(spark, primary, replica).collect())) == [("1.warc", at[0], "lost"), ("1.warc", at[1], "altered")]
