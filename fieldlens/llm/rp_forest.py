"""Embedding near-duplicates (operator 9): random-projection tree forest.

Vectors with a cosine >= 0.95 are linked; components are the connected components of the links.

1. Equal vectors are one class from the start, named by a hash of the vector; its smallest id is attached at the end.
2. Each of ``TREES`` trees halves the vectors again and again: a random direction for each depth, the median of the projections, and a
   spill around the median that goes to both sides, so that near vectors on different sides still meet.  The spill is
   never narrower than the distance of a pair at the threshold, however dense the node.  The splits of a node are learnt from a sample of at most about ``SAMPLE`` of its vectors, then every vector is routed.  Nodes with
   more than ``LEAF`` vectors are split again in the next round, whatever the size of the table.
3. Vectors of a leaf are compared with each other in double precision, large leaves in tiles of two blocks.  A pair
   that meets in several leaves counts in the first of them only, so no pairs leave a task: a tile returns the number of
   links of each vector and a spanning forest of its links.

A node of which a side of the split would hold more than ``SIDE`` (a dense group) stays a leaf and is compared exactly.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are their own component; vectors of different lengths are not compared; a null ``vec_id`` counts as the largest id; a
row that comes twice is a copy with a link to the other; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import NULL_KEY, connected_components, doc_key, forest, key_runs, materialize, release

THRESHOLD = 0.95
TREES, LEAF, SPILL = 12, 2048, 0.08
SAMPLE, LEVELS = 16384, 5
#: Least width of the spill in distances of a pair at the threshold; largest share of a node on a side of a split.
WIDTH, SIDE = 1.0, 2 / 3
BLOCK = 4096
SEED = 20


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors as bytes (null: not comparable)."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            x = np.array([np.nan if c is None else c for c in v.as_py()], dtype=np.float64) if v.is_valid else np.zeros(0)
            norm = np.sqrt((x * x).sum())
            usable = len(x) and np.isfinite(x).all() and np.isfinite(norm) and norm > 0
            out.append((x + 0.0).tobytes() if usable else None)  # + 0.0: one form of zero
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _direction(tree: int, depth: int, dim: int) -> np.ndarray:
    """The random direction of all splits of a tree at one depth."""
    return np.random.default_rng([SEED, tree, depth, dim]).standard_normal(dim)


def _learn(spill: float, leaf: int, width: float):
    """The splits below one node, from a sample: lower and upper bound by heap position (not a number: no split).

    ``width``: of the spill at least; projections of two vectors differ by about the distance between them.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, node, dim, total = int(key[0]), int(key[1]), int(key[2]), int(rows["total"].iloc[0])
        x = _matrix(pa.array(rows["x"], pa.binary()))
        low, high = np.full(1 << LEVELS, np.nan), np.full(1 << LEVELS, np.nan)
        todo = [(1, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            depth = at.bit_length() - 1
            if len(own) / len(x) * total <= leaf or depth == LEVELS or len(own) < 8:
                continue
            p = x[own] @ _direction(tree, node.bit_length() - 1 + depth, dim)
            a, b = np.quantile(p, [0.5 - spill, 0.5 + spill])
            more = max(0.0, width - (b - a)) / 2
            a, b = a - more, b + more
            left, right = own[p <= b], own[p >= a]
            if max(len(left), len(right)) <= SIDE * len(own):
                low[at], high[at] = a, b
                todo += [(2 * at, left), (2 * at + 1, right)]
        return pd.DataFrame({"tree": [tree], "node": [node], "dim": [dim], "lower": [low.tolist()], "upper": [high.tolist()]})

    return run


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes below its node that each vector falls into; a node without a split is done (negative)."""
    for batch in batches:
        if not len(batch):
            continue
        at: dict[str, list[np.ndarray]] = {k: [] for k in ("rep", "tree", "node", "dim")}
        rep, tree, node, dim = (np.asarray(batch.column(c)) for c in at)
        for t, n, d in sorted(set(zip(tree.tolist(), node.tolist(), dim.tolist()))):
            own = np.flatnonzero((tree == t) & (node == n) & (dim == d))
            x = _matrix(batch.column("x").take(pa.array(own)))
            low, high = (np.array(batch.column(c)[int(own[0])].as_py(), dtype=np.float64) for c in ("lower", "upper"))
            todo = [(1, np.arange(len(own)))]
            while todo:
                h, here = todo.pop()
                depth = h.bit_length() - 1
                if not len(here):
                    continue
                if depth == LEVELS or np.isnan(low[h]):
                    name = -n if h == 1 else (n << depth) + h - (1 << depth)
                    at["rep"].append(rep[own[here]])
                    for c, v in (("tree", t), ("node", name), ("dim", d)):
                        at[c].append(np.full(len(here), v, dtype=np.int64))
                    continue
                p = x[here] @ _direction(t, n.bit_length() - 1 + depth, d)
                todo += [(2 * h, here[p <= high[h]]), (2 * h + 1, here[p >= low[h]])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in at.values()], list(at))


def _leaves(classes: DataFrame, trees: int, leaf: int, spill: float, sample: int, width: float) -> DataFrame:
    """(rep, leaf) for every vector and leaf that holds it."""
    at = classes.select("rep", F.explode(F.array(*[F.lit(t).cast("long") for t in range(trees)])).alias("tree"),
                        F.lit(1).cast("long").alias("node"), "dim")
    done: DataFrame | None = None
    while True:
        sizes = materialize(at.groupBy("tree", "node", "dim").agg(F.count("*").alias("total")), "sizes")
        large = sizes.where(F.col("total") > leaf).where("node > 0")
        n_large = large.count()
        here = at.join(large.select("tree", "node", "dim"), ["tree", "node", "dim"], "left_anti") if n_large else at
        done = here if done is None else done.unionByName(here)
        if not n_large:
            break
        # few nodes: the table of splits is small whatever the input; many: the rows are spread over the nodes
        small = F.broadcast if n_large <= 2 * trees else (lambda df: df)
        inside = at.join(small(large), ["tree", "node", "dim"]).join(classes.select("rep", "x"), "rep")
        draw = F.pmod(F.xxhash64("rep", "tree", F.lit(SEED)), F.lit(1 << 30)) < F.lit(float(1 << 30) * sample) / F.col("total")
        splits = materialize(inside.where(draw).groupBy("tree", "node", "dim").applyInPandas(
            _learn(spill, leaf, width), "tree long, node long, dim long, lower array<double>, upper array<double>"), "splits")
        at = materialize(inside.drop("total").join(small(splits), ["tree", "node", "dim"])
                         .mapInArrow(_route, "rep long, tree long, node long, dim long"), "nodes")
    return done.select("rep", F.xxhash64("tree", "node", "dim").alias("leaf")).distinct()


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in key_runs(batches, ["leaf", "low", "high"]):
            leaf, low, high = (tile.column(c)[0].as_py() for c in ("leaf", "low", "high"))
            rep, block = np.asarray(tile.column("rep")), np.asarray(tile.column("block"))
            x = _matrix(tile.column("x"))
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            pairs = [], []
            for s in range(0, len(left), 512):
                some = left[s: s + 512]
                a, b = np.nonzero(x[some] @ x[right].T >= threshold)
                a, b = some[a], right[b]
                if low == high:
                    a, b = a[a < b], b[a < b]
                pairs[0].append(a)
                pairs[1].append(b)
            i, j = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in pairs)
            # a pair that also meets in a leaf with a smaller number counts there
            leaves = tile.column("leaves")
            flat, of = np.asarray(leaves.flatten()), np.repeat(np.arange(len(tile)), np.asarray(leaves.value_lengths()))
            of, flat = of[flat < leaf], flat[flat < leaf]
            if len(flat) and len(i):
                names, number = np.unique(flat, return_inverse=True)
                bits = np.zeros((len(tile), -(-len(names) // 8)), dtype=np.uint8)
                np.bitwise_or.at(bits, (of, number >> 3), (1 << (number & 7)).astype(np.uint8))
                mine = np.concatenate([~(bits[i[s: s + 65536]] & bits[j[s: s + 65536]]).any(axis=1)
                                       for s in range(0, len(i), 65536)])
                i, j = i[mine], j[mine]
            n = np.asarray(tile.column("n"))
            links = np.zeros(len(rep), dtype=np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            some, root = links > 0, rep[forest(len(rep), i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])],
                                             ["rep", "links", "root"])

    return run


def _near(vectors: DataFrame, threshold: float, trees: int, leaf: int, spill: float, sample: int, block: int) -> DataFrame:
    """(key, class, n_links, least) for every row of ``vectors``; least: smallest (key, class) of its component."""
    rows = (vectors.select(doc_key("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
            .mapInArrow(_vectors, "key long, x binary").withColumn("class", F.md5("x")))
    rows = materialize(rows, "vectors")
    classes = materialize(rows.where("x is not null").groupBy("class").agg(
        F.min("key").alias("key"), F.count("*").alias("n"), F.first("x").alias("x"))
        .select(F.xxhash64("class").alias("rep"), F.struct("key", "class").alias("least"), "class", "n", "x")
        .withColumn("dim", (F.octet_length("x") / 8).cast("long")), "classes")

    width = WIDTH * np.sqrt(max(0.0, 2 * (1 - threshold)))
    places = materialize(_leaves(classes.select("rep", "x", "dim"), trees, leaf, spill, sample, width), "leaves")
    sizes = (places.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
             .select("leaf", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    sizes = materialize(sizes, "sizes")
    of_rep = places.groupBy("rep").agg(F.collect_list("leaf").alias("leaves"))  # trees x spill at most
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))
    tiles = (classes.select("rep", "n", "x").join(of_rep, "rep").withColumn("leaf", F.explode("leaves"))
             .join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("cell", F.explode(cells)).select("*", "cell.low", "cell.high").drop("cell", "blocks")
             .repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high"))
    found = materialize(tiles.mapInArrow(_compare(threshold), "rep long, links long, root long"), "links")
    release(places)

    components = connected_components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    least = materialize(components.join(classes.select("rep", "least"), "rep")
                        .groupBy("component").agg(F.min("least").alias("first")), "least")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = materialize(
        classes.select("class", "rep", "n", "least").join(links, "rep", "left")
        .join(components.join(least, "component"), "rep", "left")
        .select("class", F.coalesce("first", "least").alias("least"),
                (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return rows.select("key", "class").join(of_class, "class", "left").select(
        "key", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("least", F.struct("key", "class")).alias("least"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF,
                 spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component) for every row of ``vectors`` (vec_id, embedding, ...)."""
    return _near(vectors, threshold, trees, leaf, spill, sample, block).select(
        "key", "n_links", F.col("least.key").alias("component"))


def embedding_dedup_query(spark, sf_dir: str) -> DataFrame:
    back = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    found = _near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), THRESHOLD, TREES, LEAF, SPILL, SAMPLE, BLOCK)
    return found.select(back("key").alias("vec_id"), "n_links", back("least.key").alias("component_id"),
                        (F.col("key") == F.col("least.key")).alias("kept"))
