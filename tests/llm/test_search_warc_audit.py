"""Operators 11 to 13 against brute force, and archives by exact round trips."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fieldlens.llm import filter_audit, lexical, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ID = "doc_id long, text string"


# ---------------------------------------------------------------- 11

def brute_search(docs, items, k):
    """{(item_id, text): [(doc_id, score)]} by scoring every document."""
    terms = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = {}
    for item, text in {x for x in items if x[1] is not None}:
        found = []
        for doc, c in terms:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in Counter(TERM.findall(text.translate(LOWER))).items() if t in c)
            if score > 0:
                found.append((doc, score))
        found.sort(key=lambda x: (-x[1], math.inf if x[0] is None else x[0]))
        if found:
            out[item, text] = found[:k]
    return out


def assert_same_search(spark, docs, items, found, k):
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    expected = brute_search(docs, items, k)
    assert set(got) == {i for i, _ in expected}
    for (item, _), rows in expected.items():
        assert got[item] == [(n, d, s) for n, (d, s) in enumerate(rows, 1)]


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 7])
def test_search_equals_scoring_everything(spark, block_terms):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(40)], k=rng.choice([3, 8, 30])))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)]  # groups of equal scores, larger than k
    docs += [(5000, None), (5001, ""), (5002, " .,- \x00"), (None, docs[5][1]), (5003, "ÄÖ w1É Ä"), (5004, "W1 w1, W2!w2"), (5004, "w2 w2 w2")]
    items = [(1, docs[0][1]), (2, "w0 w1 w39"), (3, "w2 w2 w2 w7"), (4, None), (5, ""), (6, "unknown terms"), (7, "ä Ä w1é W1"),
             (None, "w3 w4"), (2, "w0 w1 w39")]
    found = lexical.ranked_search(spark.createDataFrame(docs, ID).repartition(5).withColumn("term", F.lit(1)).withColumn("key", F.lit(2)),
                                  spark.createDataFrame(items, "item_id long, text string").withColumn("weight", F.lit(9)), 10, block_terms)
    assert_same_search(spark, docs, items, found, 10)


def test_search_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = [(1, "word a"), (2, odd_docs.where("doc_id = 1").first()["text"]), (2, "123 456")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    bench = spark.createDataFrame(items[:2], "item_id long, text string")
    assert_same_search(spark, docs, items[:2], lexical.ranked_search(odd_docs, bench), lexical.K)
    # one id with two texts: a ranking for each
    both = lexical.ranked_search(odd_docs, spark.createDataFrame(items[1:], "item_id long, text string"))
    assert both.count() == sum(len(v) for v in brute_search(docs, items[1:], lexical.K).values())
    assert lexical.ranked_search(no_docs, bench).count() == 0
    assert lexical.ranked_search(odd_docs, bench.where("false")).count() == 0


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(5)
    for case in range(30):
        n_terms, n_docs, k = int(rng.integers(1, 6)), int(rng.integers(1, 400)), int(rng.integers(1, 30))
        dense = rng.integers(0, 6, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < 0.5)
        term, doc = np.nonzero(dense)
        shard = lexical.Shard(n_terms, n_docs, doc, term, dense[term, doc])
        weight, ids = rng.integers(1, 4, n_terms), np.arange(n_docs) * 3
        none = np.zeros(0, dtype=np.int64)
        score, found = shard.search(np.arange(n_terms), weight, k, (none, none), ids)
        whole = weight @ dense
        order = np.lexsort((ids, -whole))
        order = order[whole[order] > 0][:k]
        assert score.tolist() == whole[order].tolist() and found.tolist() == ids[order].tolist()
    # two lists of 50,000 in the same order: the k best are found near their heads
    doc = np.tile(np.arange(50_000), 2)
    shard = lexical.Shard(2, 50_000, doc, np.repeat([0, 1], 50_000), 1_000_000 - doc)
    shard.search(np.arange(2), np.array([1, 1]), 5, (none, none), np.arange(50_000))
    assert shard.scored < 100


# ---------------------------------------------------------------- 12

def brute_warc(pages):
    payloads = [(i, (h or "").encode()) for i, h in pages]
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, p in payloads:
        first[p] = min(first.get(p, math.inf), key(i))
    rows = []
    for i, p in payloads:
        revisit = key(i) > first[p]
        rows.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response",
                     first[p] if revisit else None, None if revisit else p))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def odd_pages(spark):
    rng = random.Random(11)
    long = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(300_000))
    rows = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"),
            (4, "http://b/\r\nWARC-Type: x y", "WARC/1.1\r\n\r\nbody\r\n\r\n\r\n\r\n"), (5, "", None), (6, "u", ""), (None, "n", "<p>same</p>"),
            (None, None, "only null ids"), (7, "ü", long), (8, "http://c", "\x00 é"), (-9, "%41", "negative")]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i % 40} {'x' * (i % 97)}</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [(r[0], r[2]) for r in rows], pages.withColumns({c: F.lit(1) for c in ("key", "first", "size", "digest", "value", "payload")})


@pytest.mark.parametrize("frame_bytes,archive_bytes", [(1 << 18, 1 << 24), (2000, 9000), (1, 1)])
def test_archives_round_trip(spark, odd_pages, tmp_path, frame_bytes, archive_bytes):
    rows, pages = odd_pages
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder, frame_bytes=frame_bytes, archive_bytes=archive_bytes)
    records = warc.read_records(spark, folder).cache()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
           for r in records.collect()]
    assert sorted(got, key=repr) == brute_warc(rows)
    # any reader of Zstandard gives one WARC stream a file, and the places of the index lie in it
    streams = [zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read()
               for p in (tmp_path / "warc").glob("part-*")]
    assert sum(map(len, streams)) == records.agg(F.sum("record_bytes")).first()[0]
    if archive_bytes == 9000:
        assert records.select("archive").distinct().count() > 5 and records.agg(F.max("frame")).first()[0] > 0
    warc.write_index(spark, folder, str(tmp_path / "index"))
    place = ["page_id", "archive", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index")).select(place).collect()), key=repr) \
        == sorted(map(tuple, records.select(place).collect()), key=repr)
    ids = [7, 102, 8, 399, 12345]
    fetched = warc.fetch(spark, folder, str(tmp_path / "index"), spark.createDataFrame([(i,) for i in ids + [8]], "page_id long"))
    expected = records.where(F.col("page_id").isin(ids)).select(fetched.columns)
    assert sorted(map(tuple, fetched.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    urls = {r.page_id: r.url for r in records.where("page_id < 10").collect()}
    assert urls[4] == "http://b/%0D%0AWARC-Type:%20x%20y" and urls[2] is None and urls[5] == "" and urls[-9] == "%41"


def test_small_payloads_are_all_responses(spark, odd_pages, tmp_path):
    _, pages = odd_pages
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=12)
    types = {r.page_id: r.record_type for r in warc.read_records(spark, str(tmp_path / "w")).where("page_id < 10").collect()}
    assert types[3] == types[6] == "response"
    warc.write_archives(pages.where("false"), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives_are_refused():
    r = warc.record(1, "u", b"payload")
    archive = warc.bundle([[(1, r)], [(2, r)]])
    assert [p[2] for p in warc.seek_table(archive)] == [len(r), len(r), 0]
    assert warc.archive_index(archive) == [(1, 0, 0, len(r)), (2, 1, 0, len(r))]
    with pytest.raises(ValueError):
        warc.seek_table(archive[:-1])
    with pytest.raises(ValueError):
        warc.seek_table(archive[5:])
    with pytest.raises(ValueError):
        warc.parse(r.replace(b"payload\r", b"pAyload\r"))
    with pytest.raises(ValueError):
        warc.parse(r.replace(b"WARC/1.1", b"WARX/1.1"))


# ---------------------------------------------------------------- 13

def brute_audit(docs, labels):
    """Applies the filters one after the other, in every order."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", math.inf), key(i))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, y in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)), key(i) > first[t]]) if y)
        rows.append((s or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone, before = [r for r in left if f in r[1]], left
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in whole) - sum(f in r[1] for r in before),
                                          sum(r[1] == f for r in whole), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_applying_the_filters(spark, odd_docs, no_docs):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcABC# $", k=5)) for _ in range(60)]
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.select("doc_id", "text", "source").collect()]
    for i in range(100, 400):
        text = " ".join(rng.choices(base[:rng.choice([3, 60])] + [f"w{n}" for n in range(400)], k=rng.choice([5, 210, 450])))
        docs.append((i, rng.choice([text, docs[-1][1], docs[0][1]]), rng.choice(["a", "a", "b", "", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50, 300)] + [(None, 1, 1), (120, 1, 0), (120, 0, 1), (99999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(3))
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(
        {c: F.lit(7) for c in ("key", "part", "digest", "mask", "good", "toxic", "n", "least", "quality")}).repartition(6)
    got = {tuple(r) for r in filter_audit.filter_audit(table, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.filter_audit(no_docs, marks).count() == 0
    assert {r["toxic_lost"] + r["good_lost"] for r in filter_audit.filter_audit(odd_docs, marks.where("false")).collect()} == {0}


def test_min_plus_gives_the_first_failing_position():
    fails, position, removal = filter_audit.removal_steps()
    for mask, (n, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        steps = [s for s, f in enumerate(order) if fails[mask, "ABCDE".index(f)]]
        assert removal[mask, n] == (steps[0] if steps else math.inf)
