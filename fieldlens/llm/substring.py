"""Substring deduplication (operator 1): difference-cover anchors.

A window of ``window`` consecutive words is a repeat when the same words also start earlier: in a document with a
smaller id, or earlier in the same one.  Every word that a repeat covers is removed; windows are judged on the input.

1. *Anchors.*  ``COVER`` is a difference cover modulo ``PERIOD``: whatever the starts i and j of two equal windows,
   some shift below PERIOD takes both to positions whose remainders are in COVER.  Hashing runs of
   ``window - PERIOD + 1`` words at cover positions only (4 of 13) therefore finds every pair of equal windows.
2. *Repeated anchors.*  Anchors are counted by hash.  A task sends rows under a hash until it knows that the hash
   repeats; further occurrences go under keys of their own (``Recent``), so that a passage that is in every document
   puts a few rows for each task under one key, not one for each document or chunk.
3. *Extension.*  Every window around a repeated anchor is hashed whole (96 bits); in the order of (doc_id, start)
   all but the first of equal windows are repeats.  A window that comes after one that the task has sent is a repeat
   without further rows under its hash.

Results for odd input: a null text has no words; documents with a null ``doc_id`` come after all others, in the order of
a hash of their texts; a text shorter than the
window is kept; a row that comes twice (same id, same text) is returned twice, both judged alike; rows that share an id
but not the text are judged by (id, start) like one document; an empty table gives an empty result; other columns of
the input are carried along, but for those named like a result column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import BASES, Recent, Words, first_in_chunk, materialize, mix, own_key, signed, text_bytes, text_chunks

WINDOW = 20
#: A perfect difference set; its differences modulo 13 are all remainders.
PERIOD, COVER = 13, (0, 1, 3, 9)
RESULT = ["kept_text", "removed_spans", "n_words", "n_removed"]


def _cover_and_length(window: int) -> tuple[int, np.ndarray, int]:
    """Period, cover and anchor length; windows too short for the period take an anchor at every position."""
    if window > PERIOD:
        return PERIOD, np.isin(np.arange(PERIOD), COVER), window - PERIOD + 1
    return 1, np.ones(1, dtype=bool), window


def _spread(h: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Keys of their own for rows that need no partner."""
    return mix(h ^ mix(key.astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(40))))


def _anchors(window: int):
    period, cover, length = _cover_and_length(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for chunk in text_chunks(batches):
            words = Words(*text_bytes(chunk.column("text")))
            h, inside = words.windows(length)
            pos = words.position()[: len(h)]
            n = np.diff(words.first)[words.doc[: len(h)]]
            at = np.flatnonzero(inside & cover[pos % period] & (n >= window))
            h, pos = h[at], pos[at]
            key = np.asarray(chunk.column("key"))[words.doc[at]]
            first, count = first_in_chunk(h)
            lead = np.flatnonzero(first)
            lead = lead[np.argsort(h[lead])]
            found, sent = recent.find(h[lead])
            known = found & (sent[:, 0] > 1)  # rows sent before tell that it repeats
            recent.keep(h[lead], np.stack([sent[:, 0] + count[lead], sent[:, 1]], axis=1), found)
            first[lead[known]] = False
            count[lead[known]] = 2
            h = np.where(first, h, _spread(h, key, pos))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(key), pa.array(pos.astype(np.int32)),
                 pa.array(count.astype(np.int32))], ["h", "key", "pos", "n"])

    return run


def _windows(window: int):
    """Hashes of the windows that hold a repeated anchor."""
    period, _, length = _cover_and_length(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for chunk in text_chunks(batches):
            words = Words(*text_bytes(chunk.column("text")))
            h, inside = words.windows(window)
            h2, _ = words.windows(window, BASES[1])
            anchors = chunk.column("anchors")
            of = np.repeat(np.arange(len(chunk)), np.asarray(anchors.value_lengths().fill_null(0)))
            at = np.asarray(anchors.flatten(), dtype=np.int64)
            n = np.diff(words.first)
            of, at = of[at < n[of]], at[at < n[of]]
            # a window that starts up to window - length words before an anchor holds it
            step = np.zeros(len(words) + 1, dtype=np.int64)
            low = words.first[of] + np.maximum(0, at - (window - length))
            np.add.at(step, low, 1)
            np.add.at(step, words.first[of] + at + 1, -1)
            near = np.cumsum(step)[: len(h)] > 0
            i = np.flatnonzero(near & inside)
            key = np.asarray(chunk.column("key"))[words.doc[i]]
            pos = words.position()[i]
            h, h2 = h[i], h2[i]
            order = np.lexsort((pos, key))
            h, h2, key, pos = h[order], h2[order], key[order], pos[order]
            value, lead, inverse = np.unique(h, return_index=True, return_inverse=True)
            first = np.stack([key[lead], pos[lead]], axis=1)
            found, sent = recent.find(value)
            before = found & ((sent[:, 0] < first[:, 0]) | (sent[:, 0] == first[:, 0]) & (sent[:, 1] < first[:, 1]))
            first[before] = sent[before]  # the earliest that this task has sent
            recent.keep(value, first, found)
            first = first[inverse]
            # the same key and place again is the same window of a repeated row, not an earlier one
            again = (key != first[:, 0]) | (pos != first[:, 1])
            h = np.where(again, _spread(h, key, pos), h)
            place = (h2 & ~np.uint64(0xFFFFFFFF)) | again.astype(np.uint64) << np.uint64(31) | pos.astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(key), pa.array(signed(place))], ["h", "key", "place"])

    return run


def _cut(window: int):
    """Kept text, removed word ranges and counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = text_bytes(chunk.column("text"))
            words = Words(data, offsets)
            h2, _ = words.windows(window, BASES[1])
            check = signed(h2) >> 32
            marks = chunk.column("__marks")
            of = np.repeat(np.arange(len(chunk)), np.asarray(marks.value_lengths().fill_null(0)))
            flat = np.asarray(marks.flatten(), dtype=np.int64)
            at, mark = flat & 0x7FFFFFFF, flat >> 32
            n = np.diff(words.first)
            i = words.first[of] + at
            good = (at >= 0) & (at + window <= n[of])
            good[good] = check[i[good]] == mark[good]
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, i[good], 1)
            np.add.at(step, i[good] + window, -1)
            gone = np.cumsum(step)[:-1] > 0
            removed = np.bincount(words.doc[gone], minlength=len(chunk))
            raw = data.tobytes()
            texts, spans = [], []
            for d in range(len(chunk)):
                a, b = words.first[d], words.first[d + 1]
                if not removed[d]:
                    texts.append(b" ".join(raw[offsets[d]: offsets[d + 1]].split()).decode())
                    spans.append([])
                    continue
                keep = ~gone[a:b]
                texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[a:b][keep], words.end[a:b][keep])).decode())
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])).astype(np.int8)))
                spans.append(edges.reshape(-1, 2).tolist())
            out = chunk.drop_columns(["__marks", "__key"])
            for name, values, kind in (
                    ("kept_text", texts, pa.string()), ("removed_spans", spans, pa.list_(pa.list_(pa.int64()))),
                    ("n_words", n, pa.int64()), ("n_removed", removed, pa.int64())):
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, place) of the windows whose words also start earlier.

    The upper half of ``place`` is a hash of the window's words, the lower half its first word's number; between the
    two tasks, bit 31 tells that an earlier equal window is known already.
    """
    texts = docs.select(own_key().alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    anchors = texts.mapInArrow(_anchors(window), "h long, key long, pos int, n int")
    repeated = (anchors.withColumn("n", F.sum("n").over(Window.partitionBy("h"))).where("n > 1")
                .select("key", "pos"))
    repeated = materialize(repeated.groupBy("key").agg(F.collect_list("pos").alias("anchors")), "anchors")
    windows = (texts.join(repeated, "key").mapInArrow(_windows(window), "h long, key long, place long")
               .repartition("h").withColumn("h2", F.shiftright("place", 32)))
    order = Window.partitionBy("h", "h2").orderBy("key", "place")
    known = F.lit(1 << 31)
    return (windows.withColumn("rank", F.rank().over(order))
            .where((F.col("rank") > 1) | (F.col("place").bitwiseAND(known) != 0))
            .select("key", F.col("place").bitwiseAND(F.lit(~(1 << 31))).alias("place")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept_text, removed_spans ([first word, end] pairs), n_words, n_removed."""
    marks = materialize(repeated_windows(docs, window).groupBy(F.col("key").alias("__key"))
                        .agg(F.collect_list("place").alias("__marks")), "marks")
    rows = docs.drop(*RESULT).withColumns({"text": F.col("text").cast("string"), "__key": own_key()})
    schema = T.StructType(rows.drop("__key").schema.fields)
    schema = (schema.add("kept_text", "string").add("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))
              .add("n_words", "long").add("n_removed", "long"))
    return rows.join(marks, "__key", "left").mapInArrow(_cut(window), schema)


def substring_dedup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w
           FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM r),
gd AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
t AS (SELECT d.doc_id, d.w, coalesce(gd.gone, []) AS gone FROM d LEFT JOIN gd USING (doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, len(t.gone)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
