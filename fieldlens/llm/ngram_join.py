"""N-gram Jaccard join (operator 5): Bayesian pruning of MinHash candidates, exact verification.

Two documents are linked when the sets of their runs of five consecutive words (white-space separated, unchanged) have
a Jaccard similarity of at least 0.8; classes are the connected components of the links.

1. Documents with one and the same set are a class from the start, named by a hash of the set; the text of its smallest
   id goes on.  The smallest id of a class of near sets is attached at the end.
2. Representatives get ``BANDS * ROWS`` MinHash values.  Those that agree in a band are candidates; a bucket sends an
   edge from each member to its smallest one, never all pairs, and connected edges make a candidate group.
3. A group is compared in tiles of two blocks of about ``BLOCK`` members, so a group of any size is spread over tasks.
   In a tile, MinHash values are compared ``STEP`` at a time; after each step a pair whose posterior probability of a
   similarity >= threshold (uniform prior; m of n equal values) is below ``TOLERANCE`` is dropped.
4. The pairs left are verified exactly on the sets.  A tile returns the number of links of each member and a spanning
   forest of its links, which is as long as the tile, not all links.

A pair at 0.8 is missed by all bands with a probability of 7e-6, and pruned wrongly with one of about TOLERANCE.

Results for odd input: null and empty texts have no words, link with nothing and form their own class; texts of one to
four words are one run; a null ``doc_id`` counts as the largest id (class_id null if it is the smallest of its class);
a row that comes twice is two copies of each other, also in the counts; rows that share an id are told apart by their
sets; an empty table gives an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import (
    BASES, NULL_KEY, Words, connected_components, distinct_sorted, doc_key, forest, key_runs, materialize, mix,
    ranges_hash, signed, text_bytes, text_chunks)

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
STEP, TOLERANCE = 10, 1e-6
BLOCK = 512
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def least_matches(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values of n that leave P(similarity >= threshold) >= tolerance.

    With a uniform prior, m equal values of n give the posterior Beta(m + 1, n - m + 1), whose upper tail is the
    probability of at most m successes in n + 1 trials with chance ``threshold``.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct runs of ``size`` words, in order; shorter texts are one run."""
    words = Words(*text_bytes(column))
    h, inside = words.windows(size)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = ranges_hash(words.code, words.first[short], words.first[short + 1])
    return distinct_sorted(np.concatenate([words.doc[: len(h)][inside], short]), np.concatenate([h[inside], whole]))


def signatures(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """MinHash values of each text that has a set, one row for each, in order."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(starts), len(_A)), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(_A, _B)):
        out[:, k] = np.minimum.reduceat(((h * a + b) >> np.uint64(32)).astype(np.uint32), starts) if len(starts) else 0
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    flat = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows),
                                 [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)),
                                  pa.py_buffer(flat)])


def _sets(size: int):
    """Digest, size and MinHash values of each row's set; rows without words have the size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            doc, h = shingle_sets(chunk.column("text"), size)
            edge = np.searchsorted(doc, np.arange(len(chunk) + 1))
            d1, d2 = (ranges_hash(h, edge[:-1], edge[1:], b) for b in BASES[:2])
            sig = np.zeros((len(chunk), len(_A)), dtype=np.uint32)
            n = np.diff(edge)
            sig[n > 0] = signatures(doc, h)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("key"), chunk.column("hash"), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(n), _binary(sig)],
                ["key", "hash", "d1", "d2", "n", "sig"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS)
        h = np.zeros(sig.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h ^ (sig[:, :, r].astype(np.uint64) + (np.uint64(r + 1) << np.uint64(32))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(h.ravel())), pa.array(np.repeat(np.asarray(batch.column("rep")), BANDS))], ["band", "rep"])


def _members(size: int):
    """The sets of the candidates, from their texts; rows that come again are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in text_chunks(batches):
            new = [not (r in seen or seen.add(r)) for r in chunk.column("rep").to_pylist()]
            chunk = chunk.filter(pa.array(new, pa.bool_()))
            if not len(chunk):
                continue
            doc, h = shingle_sets(chunk.column("text"), size)
            edge = np.searchsorted(doc, np.arange(len(chunk) + 1))
            same = ranges_hash(h, edge[:-1], edge[1:], BASES[0]).view(np.int64) == np.asarray(chunk.column("d1"))
            raw = [h[edge[d]: edge[d + 1]].tobytes() for d in range(len(chunk))]
            out = chunk.select(["rep", "component", "blocks", "n_docs", "sig"]).append_column("set", pa.array(raw, pa.binary()))
            yield out.filter(pa.array(same))

    return run


def _linked(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: dict[int, int],
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Members i of ``left`` and j of ``right`` with a similarity >= threshold."""
    hits = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(STEP):
        hits += sig[left, k][:, None] == sig[right, k][None, :]
    keep = hits >= least[STEP]
    if left is right:
        keep = np.triu(keep, 1)
    a, b = np.nonzero(keep)
    hits = hits[a, b]
    for n in range(STEP, sig.shape[1], STEP):
        if not len(a):
            break
        for k in range(n, n + STEP):
            hits = hits + (sig[left[a], k] == sig[right[b], k])
        ok = hits >= least[n + STEP]
        a, b, hits = a[ok], b[ok], hits[ok]
    if not len(a):
        return left[a], right[b]
    return _verified(sets, left[a], right[b], threshold)


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    rows, cols = np.unique(i), np.unique(j)
    used = np.union1d(rows, cols)
    value, code = np.unique(np.concatenate([sets[m] for m in used]), return_inverse=True)
    edge = np.concatenate(([0], np.cumsum(size[used])))
    place = np.searchsorted(used, np.arange(len(sets)))
    both = np.zeros(len(i), dtype=np.int64)
    if len(i) * size[used].mean() * 20 > len(rows) * len(cols) * len(value) / 10:
        pick = np.searchsorted(rows, i), np.searchsorted(cols, j)
        total = np.zeros((len(rows), len(cols)), dtype=np.float32)  # whole numbers far below 2**24
        for at in range(0, len(value), 4096):
            dense = []
            for members in (rows, cols):
                x = np.zeros((len(members), 4096), dtype=np.float32)
                for r, m in enumerate(members):
                    c = code[edge[place[m]]: edge[place[m] + 1]]
                    x[r, c[(c >= at) & (c < at + 4096)] - at] = 1
                dense.append(x)
            total += dense[0] @ dense[1].T
        both = total[pick].astype(np.int64)
    else:
        for p, (x, y) in enumerate(zip(place[i], place[j])):
            both[p] = len(np.intersect1d(code[edge[x]: edge[x + 1]], code[edge[y]: edge[y + 1]], assume_unique=True))
    ok = both / (size[i] + size[j] - both) >= threshold
    return i[ok], j[ok]


def _tiles(threshold: float):
    least = {n: least_matches(n, threshold) for n in range(STEP, BANDS * ROWS + 1, STEP)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in key_runs(batches, ["component", "low", "high"]):
            rep, lead = np.unique(np.asarray(tile.column("rep")), return_index=True)  # repeated rows come once
            tile = tile.take(pa.array(lead))
            block = np.asarray(tile.column("block"))
            sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), dtype=np.uint32).reshape(len(rep), -1)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in tile.column("set").to_pylist()]
            low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            i, j = _linked(sig, sets, left, right, least, threshold)
            n_docs = np.asarray(tile.column("n_docs"))
            links = np.zeros(len(rep), dtype=np.int64)
            np.add.at(links, i, n_docs[j])
            np.add.at(links, j, n_docs[i])
            some = links > 0
            root = rep[forest(len(rep), i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])],
                                             ["rep", "links", "root"])

    return run


def _row() -> tuple[Column, Column]:
    """The id of a row and a hash of its text, which tells rows with one id apart."""
    return doc_key(), F.xxhash64(F.col("text").cast("string"))


def _classes(docs: DataFrame, size: int, threshold: float, block: int) -> DataFrame:
    """(key, hash, least, n_links) for every row of ``docs``; least: smallest (key, hash) of its class."""
    key, text_hash = _row()
    texts = docs.select(key.alias("key"), text_hash.alias("hash"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_sets(size), "key long, hash long, d1 long, d2 long, n long, sig binary"), "sets")
    classes = materialize(rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min(F.struct("key", "hash")).alias("least"), F.count("*").alias("n_docs"), F.first("sig").alias("sig"))
        .withColumn("rep", F.xxhash64("d1", "d2")), "classes")

    bands = classes.select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    buckets = materialize(bands.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n"))
                          .where("n > 1").select("band", "head"), "buckets")
    candidates = connected_components(bands.join(buckets, "band").select("rep", "head"), "rep", "head")
    groups = (candidates.groupBy("component").agg(F.count("*").alias("n"))
              .select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    members = materialize(candidates.withColumnRenamed("node", "rep").join(groups, "component")
                          .join(classes.select("rep", "d1", "n_docs", "sig", "least.key", "least.hash"), "rep"), "members")

    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))
    tiles = (texts.join(members, ["key", "hash"])
             .mapInArrow(_members(size), "rep long, component long, blocks int, n_docs long, sig binary, set binary")
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("cell", F.explode(cells)).select("*", "cell.low", "cell.high").drop("cell", "blocks")
             .repartition("component", "low", "high").sortWithinPartitions("component", "low", "high"))
    found = materialize(tiles.mapInArrow(_tiles(threshold), "rep long, links long, root long"), "links")

    verified = connected_components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    least = materialize(verified.join(classes.select("rep", "least"), "rep")
                        .groupBy("component").agg(F.min("least").alias("first")), "least")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = materialize(
        classes.select("d1", "d2", "rep", "n_docs", "least").join(links, "rep", "left")
        .join(verified.join(least, "component"), "rep", "left")
        .select("d1", "d2", F.coalesce("first", "least").alias("least"),
                (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return (rows.select("key", "hash", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2")
            .join(of_class, ["d1", "d2"], "left")
            .select("key", "hash", F.coalesce("least", F.struct("key", "hash")).alias("least"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def jaccard_classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, class_key, n_links) for every row of ``docs`` (doc_id, text, ...)."""
    return _classes(docs, size, threshold, block).select("key", F.col("least.key").alias("class_key"), "n_links")


def keep_one(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The row of each class of ``docs`` with the smallest id (and hash of the text); a row that comes twice stays once."""
    kept = materialize(_classes(docs, size, threshold, BLOCK).where("key = least.key and hash = least.hash")
                       .select(F.col("key").alias("__key"), F.col("hash").alias("__hash")).distinct(), "kept")
    key, text_hash = _row()
    return (docs.withColumns({"__key": key, "__hash": text_hash}).join(kept, ["__key", "__hash"])
            .dropDuplicates(["__key", "text"]).drop("__key", "__hash").select(*docs.columns))


def jaccard_join_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return jaccard_classes(docs).select(back("key").alias("doc_id"), back("class_key").alias("class_id"), "n_links")
