"""Benchmark decontamination (operator 7): greedy string tiling.

Tokens are runs of ASCII letters and digits and of non-ASCII characters, lower-cased.  A document and a test item are
compared if they share a seed of ``least`` consecutive tokens (an item with fewer tokens: all of it).  Their longest
common passages that do not overlap are marked, longest first, with running Karp-Rabin: fingerprints of all unmarked
runs of a search length, which goes up to the longest match found and then down to ``least``.  The share of the item's
tokens that the marked passages cover does not depend on their order; from ``threshold`` on the document is
contaminated by the item.

Items with one text are one item until the end, however often it comes; its pairs are then joined with their ids.  The
seeds of the different texts reach the tasks in blocks of about ``BLOCK_BYTES`` (an item is never cut, so that a block
can be longer by its longest item): a larger benchmark takes as many passes over the documents as it has blocks, so what
is broadcast does not grow with the data.  A document is tiled only around its own seeds, in the task that reads it;
documents are not shuffled.

Results for odd input: null or empty texts and items have no tokens and match nothing; a null ``doc_id`` or ``item_id``
is carried as null; rows that come twice give their pairs twice, and items that come twice one pair for each; an empty
table gives an empty result; columns other than doc_id and text (item_id and text) are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import Words, distinct_sorted, doc_key, materialize, text_bytes, text_chunks, windows_hash

LEAST, THRESHOLD = 5, 0.5
BLOCK_BYTES = 8 << 20
SLICE = 1 << 20
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PAIRS = "key long, text_hash long, doc_id long, item string, coverage double, n_tiles int, longest int"


def _tokens(column: pa.Array) -> Words:
    return Words(*text_bytes(pc.utf8_lower(column)), breaks=BREAKS)


def greedy_tiles(item: np.ndarray, text: np.ndarray, blocked: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles; ``blocked`` places of the text match nothing."""
    free_i, free_t = np.ones(len(item), dtype=bool), ~blocked
    tiles: list[tuple[int, int, int]] = []
    length = max(least, len(item) // 2)
    while True:
        found = _matches(item, text, free_i, free_t, length)
        if found and found[0][0] > 2 * length:
            length = found[0][0]
            continue
        for n, i, t in found:
            if free_i[i: i + n].all() and free_t[t: t + n].all():
                free_i[i: i + n] = free_t[t: t + n] = False
                tiles.append((i, t, n))
        if found:
            continue  # shortened rests of matches that were in the way may still be long enough
        if length == least:
            return tiles
        length = max(least, length // 2)


def _matches(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray,
             length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked tokens with at least ``length`` of them: (length, in item, in text), longest first."""
    if min(len(item), len(text)) < length:
        return []
    at: dict[int, list[int]] = defaultdict(list)
    wanted = set(windows_hash(item, length).tolist())
    for t, h in enumerate(windows_hash(text, length).tolist()):
        if h in wanted:
            at[h].append(t)
    found = set()
    for i, h in enumerate(windows_hash(item, length).tolist()):
        for t in at.get(h, ()):
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of the match that starts one token earlier
            n = 0
            while (i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n]
                   and item[i + n] == text[t + n]):
                n += 1
            if n >= length:
                found.add((n, i, t))
    return sorted(found, key=lambda m: (-m[0], m[1], m[2]))


def seed_index(items: list[tuple[str, str]], least: int) -> dict:
    """The tokens of the items of a block and, for each seed length, the sorted seeds with the items that hold them."""
    words = _tokens(pa.array([text for _, text in items], pa.string()))
    n = np.diff(words.first)
    by_length = {}
    for k in range(1, least + 1):
        h, inside = words.windows(k)
        of = words.doc[: len(h)]
        ok = inside & (np.minimum(n, least)[of] == k)
        item, h = distinct_sorted(of[ok], h[ok])
        if len(h):
            order = np.argsort(h, kind="stable")
            value, first = np.unique(h[order], return_index=True)
            by_length[k] = value, np.append(first, len(h)), item[order]
    return {"ids": [i for i, _ in items], "codes": [words.code[a:b] for a, b in zip(words.first, words.first[1:])],
            "size": n, "by_length": by_length}


def _seeded(words: Words, block: dict, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, places in shared seeds) where enough places may be covered.

    Seeds are counted for each text and item first, in slices of ``SLICE`` counts: a seed that all items of the block
    share costs one number an item, and the places are only gathered for items that can reach the threshold.
    """
    for k, (value, first, items) in block["by_length"].items():
        h, inside = words.windows(k)
        i = np.minimum(np.searchsorted(value, h), len(value) - 1)
        hit = np.flatnonzero((value[i] == h) & inside)
        edge = np.flatnonzero(np.diff(words.doc[hit], prepend=-1, append=-1))
        for a, b in zip(edge, edge[1:]):
            at = hit[a:b]
            low, held = first[i[at]], first[i[at] + 1] - first[i[at]]
            total = np.cumsum(held)
            count = np.zeros(len(block["size"]) if total[-1] * 4 > len(block["size"]) else 0, dtype=np.int64)
            done = 0
            while done < len(at):
                to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, side="right")))
                within = np.arange(held[done:to].sum()) - np.repeat(np.cumsum(held[done:to]) - held[done:to], held[done:to])
                of = items[np.repeat(low[done:to], held[done:to]) + within]
                if len(count):
                    count += np.bincount(of, minlength=len(count))
                done = to
            if len(count):
                some = np.flatnonzero(count)
                times = count[some]
            else:
                some, times = np.unique(of, return_counts=True)  # so few that they were one slice
            # a token of the text is in one tile at most: with fewer places the threshold is out of reach
            for item in some[times * k >= threshold * block["size"][some]].tolist():
                own = at[np.isin(h[at], windows_hash(block["codes"][item], k))]
                place = np.unique(own[:, None] + np.arange(k))
                if len(place) >= threshold * block["size"][item]:
                    yield int(words.doc[at[0]]), item, place


def _tile(seeds, least: int, threshold: float):
    """``seeds``: broadcast of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = seeds.value
        for chunk in text_chunks(batches):
            words = _tokens(chunk.column("text"))
            rows = []
            for doc, item, at in _seeded(words, block, threshold):
                code = block["codes"][item]
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                text = np.insert(words.code[at], cuts, np.uint64(0))
                blocked = np.insert(np.zeros(len(at), dtype=bool), cuts, True)
                tiles = greedy_tiles(code, text, blocked, min(least, len(code)))
                covered = sum(n for _, _, n in tiles) / len(code)
                if covered >= threshold:
                    rows.append((doc, block["ids"][item], covered, len(tiles), max(n for _, _, n in tiles)))
            doc = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [chunk.column(c).take(doc) for c in ("key", "text_hash", "doc_id")]
                + [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32()))],
                ["key", "text_hash", "doc_id", "item", "coverage", "n_tiles", "longest"])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.md5(F.col("text").cast("string")).alias("item"),
        F.col("text").cast("string").alias("text"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, text_hash, doc_id, item, coverage, n_tiles, longest); item: MD5 of the text of one or more items."""
    spark = docs.sparkSession
    items = materialize(_items(benchmark).select("item", "text").dropDuplicates(["item"]), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    texts = docs.select(doc_key().alias("key"), F.xxhash64("text").alias("text_hash"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = [(r["item"], r["text"]) for r in part.collect()]  # one block of different texts: about block_bytes
        seeds = spark.sparkContext.broadcast(seed_index(rows, least))
        if seeds.value["by_length"]:
            found.append(texts.mapInArrow(_tile(seeds, least, threshold), PAIRS))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], PAIRS)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, text_hash, doc_id, item_id, coverage, n_tiles, longest) of every contaminated document and item."""
    return (contaminated_texts(docs, benchmark, least, threshold, block_bytes)
            .join(_items(benchmark).select("item", "item_id"), "item")
            .select("key", "text_hash", "doc_id", "item_id", "coverage", "n_tiles", "longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    bad = materialize(contaminated_texts(docs, benchmark, least, threshold)
                      .select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return (docs.withColumns({"__key": doc_key(), "__hash": F.xxhash64("text")})
            .join(bad, ["__key", "__hash"], "left_anti").select(*docs.columns))


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contaminated_pairs(read("documents"), read("benchmark")).select(
        "doc_id", "item_id", "coverage", "n_tiles", "longest")
