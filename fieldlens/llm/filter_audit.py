"""Filter interaction audit (operator 13): min-plus removal ranks.

How much a quality filter removes depends on the filters before it.  The audit answers for all orders at once: for each
part (source) and each of the 120 orders of five filters, what every step keeps and removes, what an earlier step had
removed already, what the filter alone catches, which good and toxic documents it costs, and its Shapley sum.

1. *Masks*: one pass over the texts gives each document's failures of A to D (Arrow batches, numpy) and a digest of its
   text.  E (a smaller doc_id has the same text) needs the whole table: rows are counted by (digest, part, mask, labels)
   with the smallest id of each group, before any shuffle by digest, so that a text with a third of all copies reaches
   the shuffle as a few rows of each task; the smallest id of a digest is then found over these counts.
2. *Histogram*: the counts are summed by (part, mask, labels): at most 128 rows a part, whatever the number of documents.
3. *Min-plus product*: M has a row for each mask, 0 where the filter fails and infinity where it passes; P has a column
   for each order, its inverse permutation, which is the position of each filter.  Their product with + and minimum,
   R[mask, order] = min over filters (M[mask, f] + P[f, order]), is the step at which a document is removed (infinite:
   never).  Weighted scatter counts over R give removed, good_lost and toxic_lost; a failing filter at a step after R is
   redundant there.  R has 32 x 120 entries, and the histogram of each part is applied to it in one task.

Texts are compared by SHA-256, words within a text by 64-bit hash.

Results for odd input: a null text is empty (A fails, and E if another empty text has a smaller id); a null source and
an empty one are the part ''; a null doc_id counts as the largest and has no labels; equal rows are counted one by one
and fail E only by a smaller id; several labels rows of one id count as one that has all their marks; a null mark is
none; documents without labels are neither good nor toxic; empty documents give an empty result; other columns are not
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import Words, doc_key, materialize, read_table, text_bytes, text_chunks

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 200, 50, 2
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#$%&*|")] = True
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(marks)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches):
        data, offsets = text_bytes(chunk.column("text"))
        words = Words(data, offsets)
        n = np.diff(words.first)
        order = np.lexsort((words.code, words.doc))
        doc, code = words.doc[order], words.code[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        distinct = np.bincount(doc[new], minlength=len(n))
        chars = _per_text((data & 0xC0) != 0x80, offsets)
        upper = _per_text((data >= 65) & (data <= 90), offsets)
        mask = ((n < MIN_WORDS) * 1 + (100 * distinct < MIN_DISTINCT_PCT * n) * 2
                + (100 * upper > MAX_UPPER_PCT * chars) * 4 + (_per_text(SYMBOLS[data], offsets) > 0) * 8)
        yield pa.RecordBatch.from_arrays(
            [chunk.column(c) for c in ("key", "doc_id", "part", "digest")] + [pa.array(mask, pa.int32())],
            ["key", "doc_id", "part", "digest", "mask"])


def document_masks(docs: DataFrame) -> DataFrame:
    """(key, doc_id, part, digest, mask) of every document; bit 0 to 3: A to D fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return given.mapInArrow(_masks, "key long, doc_id long, part string, digest binary, mask int")


def mask_histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by all five failures; bit 4 of the mask: E fails."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    group = ["digest", "part", "mask", "good", "toxic"]
    rows = document_masks(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # equal ids of one text first, so that the rows at the smallest id are counted whole
    same_id = rows.groupBy(*group, "key").agg(F.count("*").alias("n"))
    counts = materialize(same_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("least")), "texts")
    first = counts.groupBy("digest").agg(F.min("least.key").alias("first"), F.count("*").alias("groups"))
    # a digest in one group only is its own smallest; the others meet their smallest id in a join
    shared = materialize(first.where("groups > 1").select("digest", "first"), "shared")
    kept = F.when(F.col("least.key") == F.coalesce("first", "least.key"), F.col("least.n")).otherwise(0)
    split = counts.join(shared, "digest", "left").select("part", "mask", "good", "toxic", "n", kept.alias("kept"))
    cases = F.inline(F.array(F.struct(F.col("mask").alias("all"), F.col("kept").alias("count")),
                             F.struct((F.col("mask") + 16).alias("all"), (F.col("n") - F.col("kept")).alias("count"))))
    return (split.select("part", "good", "toxic", cases).where("count > 0")
            .groupBy("part", F.col("all").alias("mask"), "good", "toxic").agg(F.sum("count").alias("n")))


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product with + for * and minimum for +."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def removal_steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fails[mask, filter], position[filter, order] and the removal step[mask, order] (0 to 4, infinite: kept)."""
    fails = (np.arange(32)[:, None] >> np.arange(5) & 1).astype(bool)
    position = np.array([[order.index(f) for order in ORDERS] for f in FILTERS], dtype=float)
    return fails, position, min_plus(np.where(fails, 0.0, np.inf), position)


def audit(histogram: pd.DataFrame) -> pd.DataFrame:
    """The 600 result rows of one part from its histogram (mask, good, toxic, n)."""
    fails, position, removal = removal_steps()
    filters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    mask, n = histogram["mask"].to_numpy(), histogram["n"].to_numpy(dtype=np.int64)
    step = removal[mask]  # of each histogram row, in each order
    gone = np.isfinite(step)
    row, order = np.nonzero(gone)
    at = step[gone].astype(int)

    def scatter(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ORDERS), len(FILTERS)), dtype=np.int64)
        np.add.at(out, (order, at), weight[row])
        return out

    removed = scatter(n)
    failing = np.zeros(len(FILTERS), dtype=np.int64)
    alone = np.zeros(len(FILTERS), dtype=np.int64)
    redundant = np.zeros(removed.shape, dtype=np.int64)
    for f in range(len(FILTERS)):
        here = fails[mask, f]
        failing[f], alone[f] = n[here].sum(), n[mask == 1 << f].sum()
        late = here[:, None] & (step < position[f])  # fails f, removed at an earlier step
        redundant[np.arange(len(ORDERS)), position[f].astype(int)] = (late * n[:, None]).sum(axis=0)
    shapley = np.zeros(len(FILTERS), dtype=np.int64)
    np.add.at(shapley, filters, removed)
    return pd.DataFrame({
        "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)),
        "kept": (n.sum() - removed.cumsum(axis=1)).ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(),
        "unique_fails": alone[filters].ravel(), "good_lost": scatter(n * histogram["good"].to_numpy()).ravel(),
        "toxic_lost": scatter(n * histogram["toxic"].to_numpy()).ravel(), "shapley": shapley[filters].ravel()})


def _audit_part(key: tuple, histogram: pd.DataFrame) -> pd.DataFrame:
    found = audit(histogram)
    found.insert(0, "part", key[0])
    return found


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; see the module's text."""
    return mask_histogram(docs, labels).groupBy("part").applyInPandas(_audit_part, RESULT)


def filter_audit_query(spark, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, len({_WORDS}) AS n, len(list_distinct({_WORDS})) AS u FROM d),
m AS (SELECT w.doc_id, part, n < 200 AS a, 100 * u < 50 * n AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS e,
             coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels l ON w.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
h AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
fl AS (SELECT part, n, good, toxic, [x.f FOR x IN [{{f: 'A', y: a}}, {{f: 'B', y: b}}, {{f: 'C', y: c}}, {{f: 'D', y: d}}, {{f: 'E', y: e}}] IF x.y] AS fs FROM h),
r AS (SELECT part, n, good, toxic, fs, o, coalesce(list_min([list_position(o, x) FOR x IN fs]), 99) AS gone FROM fl, o),
s AS (SELECT part, o, s AS step, sum(CASE WHEN gone > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone < s AND list_contains(fs, o[s]) THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fs = [o[s]] THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN gone = s THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s THEN toxic ELSE 0 END) AS toxic_lost
      FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY ALL)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, o[step])::BIGINT AS shapley FROM s
"""
