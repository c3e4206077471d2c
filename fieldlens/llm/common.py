"""Helpers that the operators of this subpackage share.

* ``materialize`` cuts lineage with a Parquet table under ``spark.checkpoint.dir`` (shared by driver and executors);
* ``text_chunks`` walks Arrow batches in pieces of bounded size; a text is never cut;
* ``Words`` finds and hashes all words of a chunk with whole-array numpy operations;
* ``connected_components`` labels a graph given by edges, without collecting any of it.

Documents with a null id count as the one with the largest id (``doc_key``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
NULL_KEY = (1 << 63) - 1
NULL_BITS = 48
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def own_key(text: str = "text", column: str = "doc_id") -> Column:
    """As ``doc_key``, but documents without an id get keys of their own by a hash of the text, behind all other ids.

    No group of rows by key then holds more than the copies of one text, however many ids are missing.
    """
    behind = F.lit(NULL_KEY) - F.xxhash64(F.col(text).cast("string")).bitwiseAND(F.lit((1 << NULL_BITS) - 1))
    return F.coalesce(F.col(column).cast("long"), behind)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- intermediate tables

def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` (or of ``setCheckpointDir``); without one there is no safe place to write."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of an execution go when it has ended (its result is on shared storage by then)."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (or the powers of its inverse)."""
    have = _powers.get((base, inverse))
    if have is None or len(have) <= n:
        b = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n + 1, 1 << 16), b, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 1 << 24:  # a very long text does not stay in memory
            _powers[base, inverse] = have
    return have[: n + 1]


def ranges_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of codes[starts[i]:ends[i]] for every i, from one running sum."""
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power(base, len(codes), False)[:-1], out=run[1:])
    return mix((run[ends] - run[starts]) * _power(base, len(codes), True)[starts])


def windows_hash(codes: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every run of n codes."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power(base, len(codes), False)[:-1], out=run[1:])
    return mix((run[n:] - run[:-n]) * _power(base, len(codes), True)[: len(codes) - n + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- texts

def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts: maximal runs of bytes that are not in ``breaks`` (ASCII white space).

    ``start`` and ``end`` are byte ranges in ``data``; ``first`` holds, for each text, the number of its first word
    (one more entry closes the last text); ``doc`` is the text of each word and ``code`` its 64-bit hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE, fold: bool = False):
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        inside = ~breaks[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[edge] = inside[edge]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[last] = inside[last]
        self.data = data
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.code = ranges_hash(BYTE_CODES[data], self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def position(self) -> np.ndarray:
        """Number of each word within its text."""
        return np.arange(len(self)) - self.first[:-1][self.doc]

    def windows(self, n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words, and whether it lies within one text."""
        h = windows_hash(self.code, n, base)
        return h, self.doc[: len(h)] == self.doc[n - 1: n - 1 + len(h)]


def first_in_chunk(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in row order: which rows are the first of their key, and the size of each row's key group."""
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(h), dtype=bool)
    is_first[first] = True
    return is_first, count[inverse]


class Recent:
    """What a task remembers of the keys it has sent: those of the last ``chunks`` chunks, and those that came back.

    A key that is in many chunks of a task is soon known, so that the task sends few rows for it.  At most ``most``
    keys that came back are kept; a key that is not remembered costs rows, not results.
    """

    def __init__(self, chunks: int = 8, most: int = 1 << 18):
        self.chunks, self.most = chunks, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.back = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct keys: whether each is remembered, and the two numbers kept with it."""
        found, value = np.zeros(len(h), dtype=bool), np.zeros((len(h), 2), dtype=np.int64)
        for keys, values in [*self.parts, self.back]:  # what was kept last counts
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = keys[at] == h
                found |= same
                value[same] = values[at[same]]
        return found, value

    def keep(self, h: np.ndarray, value: np.ndarray, back: np.ndarray) -> None:
        """``h``: sorted distinct keys; those marked ``back`` came back and stay."""
        keys, values = self.back
        old = ~np.isin(keys, h[back], assume_unique=True)
        keys = np.concatenate([keys[old], h[back]])[: self.most]
        values = np.concatenate([values[old], value[back]])[: self.most]
        order = np.argsort(keys)
        self.back = keys[order], values[order]
        self.parts = [*self.parts, (h[~back], value[~back])][-self.chunks:]


# ---------------------------------------------------------------- graphs

def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Each round points every node at its smallest neighbour, shortens the pointers until they reach a root, and
    replaces the edges by edges between roots.  The rounds end when no edge is left; what each round found is
    written to the shared folder, so that a lost executor costs no earlier round.  No node's neighbours are
    gathered in one place: smallest neighbours are combined before the shuffle.
    """
    rest = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while rest.limit(1).count():
        both = rest.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("to"))
        nodes = both.groupBy("node").agg(F.min("to").alias("to"))
        roots = rest.select(F.least("u", "v").alias("node")).distinct()
        step = materialize(nodes.unionByName(roots.withColumn("to", F.col("node")))
                           .groupBy("node").agg(F.min("to").alias("to")), "step")
        while True:
            up = step.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jumped = materialize(step.join(up, "to").select("node", F.col("up").alias("to"),
                                                            (F.col("up") != F.col("to")).alias("moved")), "jump")
            moved = jumped.where("moved").limit(1).count()
            release(step)
            step = jumped.select("node", "to")
            if not moved:
                break
        left = step.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("b"))
        following = materialize(rest.join(left, "u").join(right, "v").where("a <> b")
                                .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        release(rest)
        rest = following
        if labels is None:
            labels = step
        else:
            moves = step.select(F.col("node").alias("to"), F.col("to").alias("up"))
            labels = materialize(labels.join(moves, "to", "left")
                                 .select("node", F.coalesce("up", "to").alias("to")), "labels")
    if labels is None:
        labels = edges.select(F.col(u).alias("node"), F.col(u).alias("to")).where(F.lit(False))
    return labels.select("node", F.col("to").alias("component"))


# ---------------------------------------------------------------- grouped rows

def key_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by ``names``: one batch for each run of equal keys, also across the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = [np.asarray(batch.column(n)) for n in names]
        new = np.zeros(len(batch), dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is not None and tuple(k[0] for k in keys) != last
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield _joined(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(k[-1] for k in keys)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if len(p)]
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def distinct_sorted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, h) pairs in order."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable node of 0..n-1 for each node, by the pairs (i, j) that lie in one task."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
        apart = root[i] != root[j]
        if not apart.any() and (root[root] == root).all():
            break
    return root
