"""Operators 1 and 8 against brute force."""

import hashlib

import numpy as np
import pytest

from fieldlens.llm import bwt, substring
from fieldlens.llm.common import Recent
from tests.llm.conftest import DOC


def brute(rows, length, words):
    """Kept units and number of removed ones of each row; equal (id, start) never is earlier."""
    units = [(k, t.encode().split() if words else list(t.encode())) for k, t in rows]
    first = {}
    for k, u in units:
        for s in range(len(u) - length + 1):
            w = tuple(u[s: s + length])
            first[w] = min(first.get(w, (k, s)), (k, s))
    out = []
    for k, u in units:
        gone = np.zeros(len(u), dtype=bool)
        for s in range(len(u) - length + 1):
            if first[tuple(u[s: s + length])] < (k, s):
                gone[s: s + length] = True
        kept = [x for x, g in zip(u, gone) if not g]
        out.append((b" ".join(kept) if words else bytes(kept), int(gone.sum())))
    return out


@pytest.fixture(scope="module")
def corpus(prose):
    passage, line = prose(55), prose(22)
    rows = [(k, prose(30 + k)) for k in range(40)]
    rows += [(100 + k, f"{prose(k)} {passage} {prose(25)}") for k in range(6)]
    rows += [(200 + k, f"{line}\n{prose(9)}  {line}") for k in range(5)]
    rows += [(300, "a b " * 60), (301, "b a " * 40), (302, "a " * 90), (7, prose(44)), (7, rows[7][1])]
    return rows + [(400, passage), (401, passage), (401, passage)]


def test_words(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.kept_text, r.n_removed) for r in substring.remove_repeats(df).collect())
    want = sorted((k, t, kept.decode(), n) for (k, t), (kept, n) in zip(corpus, brute(corpus, 20, True)))
    assert got == want


def test_removed_spans_are_the_removed_words(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    for r in substring.remove_repeats(df).collect():
        words = r.text.split()
        for a, b in r.removed_spans:
            words[a:b] = [None] * (b - a)
        assert " ".join(w for w in words if w is not None) == r.kept_text


@pytest.mark.parametrize("hot", [bwt.HOT, 1])
def test_bytes(spark, corpus, hot):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, bytes(r.kept), r.n_removed) for r in bwt.remove_repeated_bytes(df, hot=hot).collect())
    want = sorted((k, t, kept, n) for (k, t), (kept, n) in zip(corpus, brute(corpus, 100, False)))
    assert got == want


def test_borders_are_those_of_the_sorted_suffixes():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(97, 100, 400), 255).astype(np.uint8)
    text[200:300] = text[50:150]
    order = bwt.suffix_array(text, 16)
    raw = text.tobytes()
    border = bwt.borders(text, order, 16)
    for row in range(1, len(order)):
        assert border[row] == (raw[order[row]:][:16] != raw[order[row - 1]:][:16])


def test_odd_rows(spark, odd_docs):
    rows = substring.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and by[2][0].n_removed == 60 and by[2][0].kept_text == ""
    assert [r.n_removed for r in by[3]] == [0, 0]  # a row that comes twice is judged alike
    assert by[4][0].n_words == by[5][0].n_words == by[6][0].n_words == 0
    assert by[7][0].n_words == 30_000 and by[7][0]["key"] == 7
    assert {r.n_removed for r in by[None]} == {0, 60}  # a null id comes last
    kept = {(r.doc_id, r.text): bytes(r.kept) for r in bwt.remove_repeated_bytes(odd_docs).collect()}
    assert len(kept) == odd_docs.distinct().count()
    assert kept[2, by[1][0].text] == b"" and kept[4, None] == b"" and len(kept[7, by[7][0].text]) > 60_000


def test_a_passage_of_every_document_puts_few_rows_under_one_hash(spark, prose):
    passage = prose(30)
    rows = [(k, f"{prose(300)} {passage} {prose(300)}") for k in range(400)] + [(None, f"{prose(5)} {passage}") for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    texts = df.select(substring.own_key().alias("key"), "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a chunk is no longer than a batch: 60 chunks
    try:
        anchors = texts.mapInArrow(substring._anchors(20), "h long, key long, pos int, n int")
        most = anchors.groupBy("h").count().agg({"count": "max"}).first()[0]
        got = sorted((str(r.doc_id), r.text, r.kept_text, r.n_removed) for r in substring.remove_repeats(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert most <= 8 and len(texts.select("key").distinct().collect()) == 600
    keys = {r.text: r.key for r in texts.collect()}
    want = [(str(k), t, kept.decode(), n) for (k, t), (kept, n) in zip(rows, brute([(keys[t], t) for _, t in rows], 20, True))]
    assert got == sorted(want)


def test_what_a_task_remembers():
    recent, few = Recent(chunks=1, most=2), np.array([3, 5, 9], dtype=np.uint64)
    recent.keep(few, np.array([[1, 0], [2, 0], [3, 0]]), np.array([False, True, True]))
    found, value = recent.find(np.array([3, 4, 9], dtype=np.uint64))
    assert found.tolist() == [True, False, True] and value[[0, 2], 0].tolist() == [1, 3]
    recent.keep(np.array([4, 9], dtype=np.uint64), np.array([[8, 0], [7, 0]]), np.array([False, True]))
    found, value = recent.find(np.array([3, 4, 5, 9], dtype=np.uint64))
    assert found.tolist() == [False, True, True, True] and value[1:, 0].tolist() == [8, 2, 7]


def test_empty_table(spark, no_docs):
    assert substring.remove_repeats(no_docs).count() == 0
    assert bwt.remove_repeated_bytes(no_docs).count() == 0


def test_queries_return_digests(spark, folder, corpus):
    at = folder(documents=spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in corpus], DOC))
    row = substring.substring_dedup_query(spark, at).where("doc_id = 400").first()
    assert row.kept_sha256 == hashlib.sha256(b"").hexdigest() and row.n_removed == row.n_words
    row = bwt.suffix_dedup_query(spark, at).where("doc_id = 400").first()
    assert row.n_spans == 1 and row.n_removed == row.n_bytes
