"""Operators 2, 7 and 10."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import html_text, mixing, tiling
from tests.llm.conftest import DOC

# ---------------------------------------------------------------- mixing


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(k, "x" * (50 + k % 20), "en", "big" if k % 3 else f"s{k % 30}", 1) for k in range(6000)]
    return spark.createDataFrame(rows, DOC)


def test_copies_follow_the_target_weights(spark, sources):
    names = [r.source for r in sources.select("source").distinct().collect()]
    weights = spark.createDataFrame([(s, 3.0 if s == "big" else 1.0) for s in names], "source string, weight double")
    got = {r.source: r.n for r in mixing.poisson_replicate(sources, weights).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sources.agg(F.sum(F.length("text"))).first()[0]
    for s in names:
        want = total * (3 if s == "big" else 1) / (len(names) + 2)
        assert abs(got[s] - want) < 6 * math.sqrt(want * 60), s


def test_counts_are_poisson(spark):
    docs = spark.createDataFrame([(k, "x", "en", "a", 1) for k in range(4000)], DOC)
    for mean in (0.3, 2.5, 150.0):
        rows = mixing.poisson_replicate(docs, total=4000 * mean).groupBy("doc_id").count().collect()
        n = np.array([r["count"] for r in rows] + [0] * (4000 - len(rows)))
        assert abs(n.mean() - mean) < 5 * math.sqrt(mean / 4000)
        assert abs(n.var() / mean - 1) < 0.15


def test_documents_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"text {k % 4000}", "en", "a", 1) for k in range(4500)], DOC)
    rows = mixing.poisson_replicate(docs, total=4500 * 0.3 * 9).groupBy("text").count().collect()
    n = {r.text: r["count"] for r in rows}
    rate = 4500 * 0.3 * 9 / sum(len(f"text {k % 4000}") for k in range(4500))
    assert abs(sum(n.values()) / 4500 - rate) < 5 * math.sqrt(2 * rate / 4500)
    assert all(n.get(f"text {k}", 0) % 2 == 0 for k in range(500))  # equal texts alike


def test_same_seed_same_copies_and_shuffled(spark, sources):
    once, again = ([tuple(r) for r in mixing.poisson_replicate(sources).select("doc_id", "copy").collect()] for _ in range(2))
    assert sorted(once) == sorted(again)
    other = mixing.poisson_replicate(sources, seed="other").select("doc_id", "copy").collect()
    assert sorted(once) != sorted(map(tuple, other))
    ids = [k for k, _ in once]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert all(sorted(c for d, c in once if d == k) == list(range(1, ids.count(k) + 1)) for k in ids[:20])


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    out = mixing.poisson_replicate(odd_docs, total=1e7)
    assert out.columns == odd_docs.columns + ["copy", "shuffle_key"]
    twice = out.where("doc_id = 3").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in twice)
    assert out.where("source is null").count() > 0
    assert mixing.poisson_replicate(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, None, "a", 1), (2, "", None, "a", 1)], DOC)
    assert mixing.poisson_replicate(empty).count() == 0


# ---------------------------------------------------------------- tiling


def brute_tiles(item, text, least):
    """Greedy string tiling by definition: mark the longest common unmarked passage again and again."""
    item, text, covered = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] is not None and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return covered
        covered += n
        item[i: i + n], text[t: t + n] = [None] * n, ["-"] * n


def test_tiles_cover_what_greedy_tiling_covers():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        text = [rng.randrange(6) for _ in range(rng.randrange(1, 60))]
        tiles = tiling.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), np.zeros(len(text), bool), 3)
        assert all(item[i: i + n] == text[t: t + n] for i, t, n in tiles)
        for k, size in ((0, len(item)), (1, len(text))):
            places = [x for tile in tiles for x in range(tile[k], tile[k] + tile[2])]
            assert len(places) == len(set(places)) and all(x < size for x in places)
        # equal lengths may be taken in another order; the longest passage is taken either way
        longest = max((n for _, _, n in tiles), default=0)
        assert abs(sum(n for _, _, n in tiles) - brute_tiles(item, text, 3)) <= 4
        assert longest == max((n for i in range(len(item)) for t in range(len(text))
                               for n in [next((m for m in range(min(len(item) - i, len(text) - t), 2, -1)
                                               if item[i: i + m] == text[t: t + m]), 0)]), default=0)


@pytest.fixture(scope="module")
def benchmark(spark, prose):
    items = [(k, prose(35)) for k in range(20)] + [(20, "Four words only here"), (21, None), (22, ""), (None, prose(30)), (5, prose(30))]
    return items, spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x"))


def test_leaks_are_found_and_others_are_not(spark, prose, benchmark):
    items, table = benchmark
    texts = dict(items[:20])
    half = texts[3].split()
    rows = [(0, prose(200)), (1, f"{prose(40)} {texts[1]} {prose(30)}"), (2, texts[2].upper().replace(" ", ", ")),
            (3, f"{' '.join(half[18:])} {prose(25)} {' '.join(half[:18])}"),  # reordered
            (4, " ".join(texts[4].split()[:10])), (5, prose(50)), (6, "said: FOUR words, only here!"), (None, texts[7]), (8, texts[8]), (8, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (tiling.BLOCK_BYTES, 400):
        got = sorted(((r.doc_id, r.item_id) for r in tiling.contaminated_pairs(docs, table, block_bytes=block).collect()), key=str)
        assert got == sorted([(1, 1), (2, 2), (3, 3), (6, 20), (None, 7), (8, 8), (8, 8)], key=str)
    left = tiling.decontaminate(docs, table)
    assert sorted(r.doc_id for r in left.collect()) == [0, 4, 5]


def test_tiling_odd_rows(spark, odd_docs, no_docs, benchmark):
    out = tiling.decontaminate(odd_docs, benchmark[1])
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    own = odd_docs.where("doc_id = 1").selectExpr("doc_id as item_id", "text")
    assert sorted(str(r.doc_id) for r in tiling.contaminated_pairs(odd_docs, own).collect()) == ["1", "14", "2", "None"] or \
        sorted(str(r.doc_id) for r in tiling.contaminated_pairs(odd_docs, own).collect()) == ["1", "14", "15", "2", "None"]
    assert tiling.contaminated_pairs(no_docs, benchmark[1]).count() == 0
    assert tiling.contaminated_pairs(odd_docs, benchmark[1].limit(0)).count() == 0


def test_items_that_come_often_are_one_item_until_the_end(spark, prose, monkeypatch):
    often, other = prose(40), prose(40)
    rows = [(k, often) for k in range(3000)] + [(5000, other)]
    table = spark.createDataFrame(rows, "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(1, f"{prose(9)} {often}"), (2, prose(80)), (3, other)], "doc_id long, text string")
    blocks = []
    index = tiling.seed_index
    monkeypatch.setattr(tiling, "seed_index", lambda items, least: blocks.append(len(items)) or index(items, least))
    got = tiling.contaminated_pairs(docs, table).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, k) for k in range(3000)] + [(3, 5000)]
    assert blocks == [2]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_seeds_that_all_items_share(monkeypatch, size):
    monkeypatch.setattr(tiling, "SLICE", size)
    rng = random.Random(5)
    shared = " ".join(f"s{k}" for k in range(6))
    items = [(str(k), " ".join([shared, *(f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 12)))])) for k in range(300)]
    items += [("short", "s1 s2"), ("one", "w7")]
    texts = [f"{shared} x {items[7][1]} y {shared}", "none of them", f"w7 {shared}", " ".join(t for _, t in items[:40])]
    words = tiling._tokens(pa.array(texts))
    got = {(d, i): set(at.tolist()) for d, i, at in tiling._seeded(words, tiling.seed_index(items, 5), 0.5)}
    want = {}
    for i, (_, text) in enumerate(items):
        item = text.split()
        k = min(5, len(item))
        seeds = {tuple(item[a: a + k]) for a in range(len(item) - k + 1)}
        at = 0
        for d, t in enumerate(texts):
            t = t.split()
            places = {at + a + x for a in range(len(t) - k + 1) if tuple(t[a: a + k]) in seeds for x in range(k)}
            if len(places) >= 0.5 * len(item):
                want[d, i] = places
            at += len(t)
    assert got == want


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><header><h1>Head&amp;line</h1></header><p>One <b>bo</b>ld&nbsp;&eacute; &#233;<br>two<p>three
 four<div class="advert"><p>Buy more</p></div><form><input><label>Name</label></form>
<table><tr><td>a<td>b</table>%s<div id="comments"><article class="comment">Reader</article></div></article>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def one(spark, *rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html_text.extract_text(df).orderBy("page_id").collect()]


def test_article_only(spark):
    assert one(spark, (1, "http://a/1", PAGE % "")) == ["Head&line One bold é é two three four a b"]


def test_broken_markup(spark):
    assert one(spark, (1, "u", "<body><nav>Menu<article>Text <b>bold<p>more"), (2, "u", "plain &lt;text&gt; &unknown; &amp x"),
               (3, "u", "<main>" + "<div>" * 5000 + "deep"), (4, "u", "<p>a</p></div></p><p>b<script>never ends"),
               (5, "u", "<body><p hidden>x</p><p style='display: none'>y</p>z<!-- open")) == [
        "Text bold more", "plain <text> &unknown; & x", "deep", "a b", "z"]


def test_templates_are_what_recurs_on_the_host(spark):
    def page(k, host, own):
        return (k, f"https://{host}/{k}", f"<html><body><div><span>Follow us on {host}</span></div><article><p>own {own}</p>"
                                          f"<div class=x><p>Sign up</p><p>for {host}</p></div><p>same</p></article></body></html>")

    rows = [page(k, "a.example", k) for k in range(10)] + [page(100 + k, "b.example", k) for k in range(3)]
    rows += [page(200 + k, "c.example", 0) for k in range(10)]  # copies of one page are no template
    got = one(spark, *rows)
    assert got[:10] == [f"own {k}" for k in range(10)]
    assert got[10:13] == [f"own {k} Sign up for b.example same" for k in range(3)]
    assert got[13:] == ["own 0 Sign up for c.example same"] * 10


def test_html_odd_rows(spark, prose):
    rows = [(1, None, None), (2, "x", ""), (None, None, "<p>a</p>"), (3, "http://h/", None), (4, "http://h/", "<article>" + prose(30_000)),
            (4, "http://h/", "<article>x"), (4, "http://h/", "<article>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("host", "templates", "n_chars", "subtree", "page", "n")})
    out = html_text.extract_text(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text) and r.host == 1 and r.templates == 1
    assert got[1] == got[2] == got[3] == [""] and got[None] == ["a"] and sorted(got[4])[:2] != [] and len(got[4]) == 3
    assert sorted(map(len, got[4]))[:2] == [1, 1] and max(map(len, got[4])) > 60_000
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_article_parts_with_telling_names_stay():
    assert html_text.main_text('<article><p class="alert-success">Done</p><div id="discussion"><p>Discussion section</p></div>'
                               '<div class="related-work">Others</div><footer>f</footer><div class="comments">c</div></article>',
                               frozenset()) == "Done Discussion section Others"
    assert html_text.main_text('<body><div class="related">r</div><p>Text</p></body>', frozenset()) == "Text"


def test_menus_without_names_go_by_their_counts(spark):
    page = '<body><div class="x1"><a>Home</a> <a>About</a></div><div>{}</div><div class="x2">Bottom line</div></body>'
    rows = [(i, f"http://host/{i}", page.format(f"<p>Text number {i}</p>")) for i in range(12)]
    rows += [(100, "http://other/1", page.format("<p>Alone</p>"))]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in out.collect()}
    assert got[3] == "Text number 3" and got[100] == "Home About Alone Bottom line"


def test_very_deep_markup_takes_linear_time():
    import time

    for html in ("<div>" * 200_000 + "end", "<p><table><tr><td>" + "<div>x" * 100_000, "<article>" * 100_000 + "a",
                 "<article>a</article><nav>b</nav>" * 50_000):
        start = time.time()
        page = html_text.main_text(html, frozenset([1]))
        html_text.subtrees(html)
        assert time.time() - start < 20 and page
