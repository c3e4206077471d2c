"""Ranked lexical search (operator 11): Best Position Algorithm over impact lists.

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.  The score of a document
is the sum, over the terms of the query with repeats, of the term's weight w and the document's impact for that term,

    w = floor(1000 ln((2N + 2) / (2 df + 1))),   impact = 10^9 tf div (1000 tf + 12 m),   m = 75 + 25 n N div L

(N: documents with a term, L: all terms, df: documents with the term, n: terms of the document, tf: of them this one).

1. *Statistics*: one pass over all documents gives N, L and df of every term; tasks send sums, not occurrences.
2. *Queries*: their terms with weight times repeats, in blocks of at most about ``BLOCK_TERMS`` rows.  A block is what is
   broadcast; a larger query set takes as many passes over the documents as it has blocks.
3. *Search*: a task cuts its documents into shards and sorts, for each term of the block, the shard's impact list.  For
   each query, all its lists are read by direct access at their *best position*: the end of the longest prefix whose
   documents have all been seen, in this list or by direct access from another one.  A document that is met is scored at
   once by direct accesses to the other lists, which moves their best positions too.  A document not seen yet lies
   behind every best position, so the impacts there bound its score; the search of a shard stops when this bound is
   *strictly* below the k-th best score (of this and the earlier shards of the task): a document with an equal score
   and a smaller id is still found.  Exhausted lists add nothing to the bound.
4. The best k of each task are merged in two steps, the first salted by document.

The result is exact up to collisions of 64-bit term hashes.

Results for odd input: null texts and texts without terms are no documents of N and are never found; an item without
terms, or whose terms occur nowhere, has no rows; equal (item_id, text) rows are one item, one item_id with different
texts has a ranking for each text; repeated documents are ranked one by one; a null doc_id counts as the largest and a
null item_id as an id of its own; empty tables give an empty result; columns other than doc_id and text (item_id and
text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import NULL_KEY, Words, doc_key, materialize, read_table, signed, text_bytes, text_chunks

K = 20
BLOCK_TERMS = 400_000
#: A shard is closed at this many postings, or when its table of places (terms x documents) has this many entries.
SHARD_POSTINGS, SHARD_PLACES = 2_000_000, 16_000_000
#: Distinct terms that a task gathers before it sends their sums.
HELD_TERMS = 500_000
SALTS = 64
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(column: pa.Array) -> Words:
    return Words(*text_bytes(column), breaks=BREAKS, fold=True)


def _postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of every text and different term of it."""
    order = np.lexsort((words.code, words.doc))
    doc, code = words.doc[order], words.code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return doc[at], code[at], np.diff(np.append(at, len(code)))


# ---------------------------------------------------------------- statistics

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sums(terms, counts):
        term, inverse = np.unique(np.concatenate(terms), return_inverse=True)
        return term, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    def rows(term, df, total):
        return pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df, pa.int64()), pa.array(total, pa.int64())],
                                          ["term", "df", "total"])

    held: tuple[list, list] = ([], [])
    size = texts = total = 0
    for chunk in text_chunks(batches):
        words = _words(chunk.column("text"))
        _, code, _ = _postings(words)
        texts += int((np.diff(words.first) > 0).sum())
        total += len(words)
        term, df = np.unique(code, return_counts=True)
        held[0].append(term), held[1].append(df)
        size += len(term)
        if size > 2 * HELD_TERMS:
            term, df = sums(*held)
            held, size = ([term], [df]), len(term)
            if size > HELD_TERMS:
                yield rows(signed(term), df, np.zeros(size))
                held, size = ([], []), 0
    if size:
        term, df = sums(*held)
        yield rows(signed(term), df, np.zeros(len(term)))
    yield rows([None], [texts], [total])


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df) of every term hash of ``docs``, and one row with a null term: df = N, total = L."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "term long, df long, total long")
    return materialize(sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "terms")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        doc, code, tf = _postings(_words(chunk.column("text")))
        doc = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [chunk.column("item").take(doc), chunk.column("text_hash").take(doc), pa.array(signed(code)), pa.array(tf, pa.int64())],
            ["item", "text_hash", "term", "repeats"])


def weighted_queries(items: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """(item, text_hash, term, weight): w times repeats of every query term that occurs in a document."""
    distinct = items.select(doc_key("item_id").alias("item"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").withColumn("text_hash", F.xxhash64("text")).distinct()
    terms = distinct.mapInArrow(_query_terms, "item long, text_hash long, term long, repeats long")
    w = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return materialize(terms.join(stats.where("term is not null").select("term", "df"), "term")
                       .select("item", "text_hash", "term", (w * F.col("repeats")).cast("long").alias("weight"))
                       .where("weight > 0"), "queries")


# ---------------------------------------------------------------- best positions

class Shard:
    """The impact lists of some documents for the terms 0..n-1, and the place of each document in each list."""

    def __init__(self, n_terms: int, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], np.append(impact[order], 0)  # the last place is "not in this list"
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.place = np.full((n_terms, n_docs), len(order), dtype=np.int32)
        self.place[term[order], self.doc] = np.arange(len(order))
        self.n_docs, self.scored = n_docs, 0

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray],
               ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best k (score, id) of ``best`` and the documents of this shard, whose numbers ascend with ``ids``."""
        size = self.first[terms + 1] - self.first[terms]
        terms, weight, size = terms[size > 0], weight[size > 0], size[size > 0]
        start, at = self.first[terms], np.zeros(len(terms), dtype=np.int64)
        seen = np.zeros(self.n_docs, dtype=bool)
        step = 8
        while (at < size).any():
            ahead = at[:, None] + np.arange(step)
            inside = ahead < size[:, None]
            met = self.doc[(start[:, None] + ahead)[inside]]
            fresh = np.unique(met[~seen[met]])
            if len(fresh):
                seen[fresh] = True
                self.scored += len(fresh)
                score = weight @ self.impact[self.place[terms[:, None], fresh[None, :]]]
                least = best[0][-1] if len(best[0]) == k else 1
                good = score >= least
                if good.any():
                    score, found = np.concatenate([best[0], score[good]]), np.concatenate([best[1], ids[fresh[good]]])
                    top = np.lexsort((found, -score))[:k]
                    best = score[top], found[top]
            at = self._best_positions(start, size, at, seen, step)
            bound = int((weight * np.where(at < size, self.impact[start + at - 1], 0)).sum())
            if len(best[0]) == k and bound < best[0][-1]:
                break
            step = min(2 * step, 512)
        return best

    def _best_positions(self, start, size, at, seen, step) -> np.ndarray:
        """For each list, the number of leading documents that have all been seen."""
        at = at.copy()
        live = np.flatnonzero(at < size)
        while len(live):
            ahead = at[live, None] + np.arange(2 * step)
            inside = ahead < size[live, None]
            run = inside & seen[self.doc[np.where(inside, start[live, None] + ahead, 0)]]
            run = np.logical_and.accumulate(run, axis=1).sum(axis=1)
            at[live] += run
            live = live[(run == 2 * step) & (at[live] < size[live])]
        return at


def _search(block, n: int, total: int, k: int):
    """``block``: broadcast (terms in order, [(term numbers, weights) of each query])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, queries = block.value
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(queries)
        held: list[tuple] = []
        in_shard = np.zeros(len(value), dtype=bool)
        n_docs = n_postings = 0

        def close():
            ids = np.concatenate([h[0] for h in held])
            rank = np.empty(len(ids), dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            rank[order] = np.arange(len(ids))
            doc, term, impact = (np.concatenate([h[c] for h in held]) for c in (1, 2, 3))
            present, local = np.unique(term, return_inverse=True)
            shard = Shard(len(present), len(ids), rank[doc], local, impact)
            number = np.full(len(value) + 1, -1, dtype=np.int64)
            number[present] = np.arange(len(present))
            for q, (terms, weight) in enumerate(queries):
                here = number[terms]
                if (here >= 0).any():
                    best[q] = shard.search(here[here >= 0], weight[here >= 0], k, best[q], ids[order])

        for chunk in text_chunks(batches):
            words = _words(chunk.column("text"))
            doc, code, tf = _postings(words)
            length = np.diff(words.first)
            term = np.minimum(np.searchsorted(value, code), len(value) - 1)
            wanted = value[term] == code
            doc, term, tf = doc[wanted], term[wanted], tf[wanted]
            m = 75 + 25 * length[doc] * n // max(total, 1)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
            some, doc = np.unique(doc, return_inverse=True)
            if not len(some):
                continue
            places = (n_docs + len(some)) * (int(in_shard.sum()) + len(np.unique(term)))
            if held and (n_postings + len(doc) > SHARD_POSTINGS or places > SHARD_PLACES):
                close()
                held, n_docs, n_postings = [], 0, 0
                in_shard[:] = False
            in_shard[term] = True
            held.append((np.asarray(chunk.column("key"))[some], doc + n_docs, term, impact))
            n_docs += len(some)
            n_postings += len(doc)
        if held:
            close()
        number = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
        if len(number):
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.concatenate([b[1] for b in best])),
                                              pa.array(np.concatenate([b[0] for b in best]))], ["query", "key", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    stats = term_statistics(docs)
    whole = stats.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    n, total = whole[0] or 0, whole[1] or 0
    queries = weighted_queries(items, stats, n)
    rows = queries.count()
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text"))
    blocks = -(-rows // block_terms)
    found = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item", "text_hash"), F.lit(blocks)) == b).toPandas()  # about block_terms rows
        if not len(part):
            continue
        value, term = np.unique(part["term"].to_numpy(dtype=np.int64).view(np.uint64), return_inverse=True)
        names, lists = [], []
        for (item, text_hash), group in part.assign(number=term).groupby(["item", "text_hash"]):
            names.append((len(names), int(item), int(text_hash)))
            lists.append((group["number"].to_numpy(), group["weight"].to_numpy(dtype=np.int64)))
        best = texts.mapInArrow(_search(spark.sparkContext.broadcast((value, lists)), n, total, k), "query int, key long, score long")
        found.append(best.join(spark.createDataFrame(names, "query int, item long, text_hash long"), "query").drop("query"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionAll, found).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    for by in (["item", "text_hash", "salt"], ["item", "text_hash"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    given = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return best.select(given("item").alias("item_id"), "rank", given("key").alias("doc_id"), "score")


def ranked_search_query(spark, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT doc_id, n, unnest(ts) AS term FROM (SELECT doc_id, {_TERMS} AS ts, len({_TERMS}) AS n FROM documents)),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM d GROUP BY ALL),
s AS (SELECT count(DISTINCT doc_id)::BIGINT AS nn, count(*)::BIGINT AS ll FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
           FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
