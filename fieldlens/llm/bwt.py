"""Suffix-array deduplication (operator 8): threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id,
or earlier in the same one.  Strings are judged on the input and do not cross documents.

1. *Segments.*  The minimizer of a string is its ``GRAM``-byte gram with the smallest hash.  Equal strings have equal
   minimizers, so consecutive strings with one minimizer form a segment, and the segments of one minimizer hold all
   that can be equal to each other.  Of equal segments the earliest stands for all; the others are repeats at once.
2. *Transforms.*  Where different segments share a minimizer, their bytes are brought together, some thousand segments
   at a time: suffix array (prefix doubling), Burrows-Wheeler transform, and the common prefixes of neighbouring
   suffixes by increasing value: breadth first, each new border between suffixes that differ after l bytes gives, by
   backward extension with every byte before them, the borders after l + 1 bytes.  It stops at ``length``; suffixes
   with no border between them share that many bytes, and all but the earliest are repeats.
3. A minimizer with more than ``HOT`` different segments is cut into single strings, whose minimizer is the whole
   string, so that no minimizer gathers an unbounded group in a task.

Results for odd input: a null text is empty; a null ``doc_id`` counts as the largest id; texts shorter than ``length``
are kept; a row that comes twice (same id, same text) is returned twice, both judged alike; rows that share an id but
not the text are judged by (id, start) like one document; an empty table gives an empty result; columns named like a
result column are replaced.  What is left of a text can end within a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm.common import (
    BASES, BYTE_CODES, doc_key, materialize, mix, ranges_hash, signed, text_bytes, text_chunks, windows_hash)

LENGTH, GRAM = 100, 32
HOT = 50_000
BATCH_BYTES = 1 << 20
PIECE = 1 << 23
_INDEX = np.uint64((1 << 24) - 1)
SEPARATOR = 0xFF  # no byte of UTF-8
RESULT = ["kept", "removed_spans", "n_bytes", "n_removed"]
SEGMENTS = "m long, s1 long, s2 long, key long, place long"


# ---------------------------------------------------------------- segments

def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    n, size = len(h) - width + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size: width - size + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimizer, first string, end) of the segments of some texts; positions are in ``data``."""
    codes = BYTE_CODES[data]
    found = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = codes[at: at + PIECE + length - 1]
        if len(piece) < length:
            break
        h = windows_hash(piece, gram)
        least = _sliding_least((h & ~_INDEX) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        where = (least & _INDEX).astype(np.int64)
        start = at + np.arange(len(where))
        end_of = offsets[np.searchsorted(offsets, start, side="right")]
        ok = start + length <= end_of
        start, where = start[ok], where[ok]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (where[1:] != where[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        if len(first):
            found.append((h[where[first]], start[first], start[last] + 1))
    if not found:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing.astype(np.uint64), nothing, nothing
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(data: np.ndarray, minimizer: np.ndarray, first: np.ndarray, end: np.ndarray, key: np.ndarray,
          start: np.ndarray, length: int) -> pa.RecordBatch:
    """Segment rows; of equal ones in the batch all but the earliest are marked (negative place) and sent anywhere."""
    codes = BYTE_CODES[data]
    s1, s2 = (ranges_hash(codes, first, end + length - 1, b) for b in BASES[:2])
    place = start << 8 | (end - first)
    order = np.lexsort((place, key, s1))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = s1[order][1:] == s1[order][:-1]
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    again = np.zeros(len(order), dtype=bool)
    k, p = key[order], place[order]
    again[order] = same & ((k != k[lead]) | (p != p[lead]))
    minimizer = np.where(again, mix(minimizer ^ mix(key.astype(np.uint64) + (start.astype(np.uint64) << np.uint64(32)))), minimizer)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(x)) for x in (minimizer, s1, s2)] + [pa.array(key), pa.array(np.where(again, ~place, place))],
        ["m", "s1", "s2", "key", "place"])


def _cut_texts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = text_bytes(chunk.column("text"))
            minimizer, first, end = segments(data, offsets, length, gram)
            doc = np.searchsorted(offsets, first, side="right") - 1
            yield _rows(data, minimizer, first, end, np.asarray(chunk.column("key"))[doc], first - offsets[doc], length)

    return run


def _cut_hot(length: int):
    """Every string of the segments as a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "bytes"):
            data, offsets = text_bytes(chunk.column("bytes"))
            n = np.diff(offsets) - length + 1
            of = np.repeat(np.arange(len(chunk)), n)
            shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = offsets[of] + shift
            minimizer = ranges_hash(BYTE_CODES[data], first, first + length, BASES[2])
            start = (np.asarray(chunk.column("place")) >> 8)[of] + shift
            yield _rows(data, minimizer, first, first + 1, np.asarray(chunk.column("key"))[of], start, length)

    return run


def _judged(rows: DataFrame) -> DataFrame:
    """Segment rows that are repeats (``again``) or share their minimizer with a different segment."""
    rows = rows.repartition("m")
    rank = F.rank().over(Window.partitionBy("m", "s1", "s2").orderBy("key", "place"))
    rows = rows.withColumn("again", (F.col("place") < 0) | (rank > 1))
    rows = rows.withColumn("group", F.when(~F.col("again"), F.struct("s1", "s2")))
    near = Window.partitionBy("m", "again").orderBy("s1", "s2")
    other = F.lag("s1").over(near).isNotNull() | F.lead("s1").over(near).isNotNull()
    return (rows.withColumn("other", other).where("again or other")
            .select("m", "s1", "key", F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("place"), "again"))


def _fetch(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = text_bytes(chunk.column("text"))
            wanted = chunk.column("wanted")
            of = np.repeat(np.arange(len(chunk)), np.asarray(wanted.value_lengths()))
            m, s1, place = (np.asarray(wanted.flatten().field(k), dtype=np.int64) for k in range(3))
            first = offsets[of] + (place >> 8)
            end = first + (place & 255) + length - 1
            ok = end <= offsets[of + 1]
            ok[ok] = ranges_hash(BYTE_CODES[data], first[ok], end[ok]).view(np.int64) == s1[ok]
            raw = data.tobytes()
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[at]), pa.array(np.asarray(chunk.column("key"))[of[at]]), pa.array(place[at]),
                 pa.array([raw[a:b] for a, b in zip(first[at].tolist(), end[at].tolist())], pa.binary())],
                ["m", "key", "place", "bytes"])

    return run


# ---------------------------------------------------------------- transforms

def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` bytes at least."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        value = value << np.uint64(8) | padded[k: k + n]
    known = 8
    while True:
        order = np.argsort(value)
        ranked = value[order]
        new = np.ones(n, dtype=np.uint64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new)
        if known >= depth or int(rank[order[-1]]) == n:
            return order
        value = rank * np.uint64(n + 1)
        value[:-known] += rank[known:]
        known *= 2


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix array: does it share fewer than ``length`` bytes with the row before?

    Breadth-first backward extension on the transform: a border after l bytes at row b gives a border after l + 1 bytes
    at the row where each byte that occurs right below b (up to the next border) and whose occurrence before lies above
    b leads to.  Rows are set once, by increasing number of common bytes.
    """
    n = len(text)
    before = text[order - 1]  # the byte before the first one is the last separator
    by_byte = np.argsort(before, kind="stable")
    leads_to = np.empty(n, dtype=np.int64)
    leads_to[by_byte] = np.arange(n)
    above = np.full(n, -1, dtype=np.int64)
    chained = before[by_byte][1:] == before[by_byte][:-1]
    above[by_byte[1:][chained]] = by_byte[:-1][chained]
    border = np.zeros(n + 1, dtype=bool)
    border[n] = True
    fresh = np.flatnonzero(np.concatenate(([True], ~chained)))
    border[fresh] = True
    for _ in range(1, length):
        ends = np.flatnonzero(border)
        stop = ends[np.searchsorted(ends, fresh, side="right")]
        size = stop - fresh
        row = np.arange(size.sum()) + np.repeat(fresh - (np.cumsum(size) - size), size)
        target = leads_to[row[above[row] < np.repeat(fresh, size)]]
        fresh = np.unique(target[~border[target]])
        if not len(fresh):
            break
        border[fresh] = True
    return border[:n]


def repeats(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(key, place, s1) of the runs of strings in the segments that also start earlier in one of them."""
    size = np.asarray(pc.binary_length(batch.column("bytes")), dtype=np.int64)
    data, offsets = text_bytes(batch.column("bytes"))
    text = np.insert(data, offsets[1:], SEPARATOR)
    begin = offsets[:-1] + np.arange(len(batch))
    order = suffix_array(text, length)
    group = np.empty(len(text), dtype=np.int64)
    group[order] = np.cumsum(borders(text, order, length))
    n = size - length + 1
    of = np.repeat(np.arange(len(batch)), n)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    key = np.asarray(batch.column("key"))[of]
    start = (np.asarray(batch.column("place")) >> 8)[of] + shift
    group = group[begin[of] + shift]
    often = np.flatnonzero(np.bincount(group)[group] > 1)
    often = often[np.lexsort((start[often], key[often], group[often]))]
    g, k, s = group[often], key[often], start[often]
    new = np.ones(len(often), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(often)), 0)) if len(often) else often
    again = np.zeros(len(of), dtype=bool)
    again[often] = (k != k[lead]) | (s != s[lead])
    at = np.flatnonzero(again)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (of[at][1:] != of[at][:-1])
    first = at[new]
    run = np.diff(np.append(np.flatnonzero(new), len(at)))
    low = offsets[of[first]] + shift[first]
    s1 = ranges_hash(BYTE_CODES[data], low, low + run + length - 1)
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(start[first] << 8 | run), pa.array(signed(s1))],
                                      ["key", "place", "s1"])


def _transform(length: int):
    """Segments sorted by minimizer, taken together up to about BATCH_BYTES, never within a minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, size = None, 0
        for batch in batches:
            m = np.asarray(batch.column("m"))
            total = np.cumsum(np.asarray(pc.binary_length(batch.column("bytes")), dtype=np.int64))
            new = np.ones(len(m), dtype=bool)
            new[1:] = m[1:] != m[:-1]
            if len(m):
                new[0] = m[0] != last
                last = m[-1]
            at = 0
            for cut in np.flatnonzero(new).tolist():
                done = int(total[cut - 1]) if cut else 0
                gone = int(total[at - 1]) if at else 0
                if size + done - gone >= BATCH_BYTES:
                    held.append(batch.slice(at, cut - at))
                    yield repeats(pa.concat_batches(held), length)
                    held, size, at = [], 0, cut
            if at < len(m):
                held.append(batch.slice(at))
                size += int(total[-1]) - (int(total[at - 1]) if at else 0)
        if held:
            yield repeats(pa.concat_batches(held), length)

    return run


# ---------------------------------------------------------------- the operator

def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = text_bytes(chunk.column("text"))
            marks = chunk.column("__marks")
            of = np.repeat(np.arange(len(chunk)), np.asarray(marks.value_lengths().fill_null(0)))
            place, s1 = (np.asarray(marks.flatten().field(k), dtype=np.int64) for k in range(2))
            first = offsets[of] + (place >> 8)
            end = first + (place & 255) + length - 1
            ok = end <= offsets[of + 1]
            ok[ok] = ranges_hash(BYTE_CODES[data], first[ok], end[ok]).view(np.int64) == s1[ok]
            step = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(step, first[ok], 1)
            np.add.at(step, end[ok], -1)
            gone = np.cumsum(step)[:-1] > 0
            kept, spans, removed = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                spans.append(edges.reshape(-1, 2).tolist())
                removed.append(int(own.sum()))
                kept.append(data[a:b][~own].tobytes())
            out = chunk.drop_columns(["__marks", "__key"])
            for name, values, kind in (
                    ("kept", kept, pa.binary()), ("removed_spans", spans, pa.list_(pa.list_(pa.int64()))),
                    ("n_bytes", np.diff(offsets), pa.int64()), ("n_removed", removed, pa.int64())):
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept (binary), removed_spans ([first byte, end] pairs), n_bytes, n_removed."""
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    judged = materialize(_judged(texts.mapInArrow(_cut_texts(length, gram), SEGMENTS)), "segments")
    marks = [judged.where("again").select("key", "place", "s1")]

    sizes = judged.where("not again").groupBy("m").agg(F.count("*").alias("n"))
    many = materialize(sizes.where(F.col("n") > hot).select("m"), "hot")
    apart = many.limit(1).count() > 0
    wanted = judged.where("not again").groupBy("key").agg(F.collect_list(F.struct("m", "s1", "place")).alias("wanted"))
    pieces = texts.join(wanted, "key").mapInArrow(_fetch(length), "m long, key long, place long, bytes binary")
    if apart:
        pieces = materialize(pieces, "pieces")
        single = materialize(_judged(pieces.join(many, "m").select("key", "place", "bytes")
                                     .mapInArrow(_cut_hot(length), SEGMENTS)), "single")
        marks.append(single.where("again").select("key", "place", "s1"))
        pieces = pieces.join(many, "m", "left_anti")
    found = (pieces.repartition("m").sortWithinPartitions("m", "key", "place")
             .mapInArrow(_transform(length), "key long, place long, s1 long"))
    marks.append(materialize(found, "repeats"))

    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    every = materialize(every.groupBy(F.col("key").alias("__key"))
                        .agg(F.collect_list(F.struct("place", "s1")).alias("__marks")), "marks")
    rows = docs.drop(*RESULT).withColumns({"text": F.col("text").cast("string"), "__key": doc_key()})
    schema = T.StructType(rows.drop("__key").schema.fields)
    schema = (schema.add("kept", "binary").add("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))
              .add("n_bytes", "long").add("n_removed", "long"))
    return rows.join(every, "__key", "left").mapInArrow(_strip(length), schema)


def suffix_dedup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS s FROM d),
m AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM m) WHERE k > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= b + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
      FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM r)),
a AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, g),
e AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS f FROM a),
c AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
             string_agg(substr(d.h, 2 * f + 1, 2 * (lo - f)), '' ORDER BY lo) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.h ELSE c.kept || substr(d.h, 2 * c.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
