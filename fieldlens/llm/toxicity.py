"""Toxicity scores (operator 4): non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train linear classifiers in numpy; no document counts as known clean.

1. *Features* are the different words of a document and the runs of ``GRAMS`` bytes in them (lower-cased, with the
   borders of the word), hashed into ``BUCKETS``.  They are counted over the confirmed documents and over all training
   documents; the ``FEATURES`` whose rates differ most, in units of their error, are the model's inputs, the others
   have no weight.
2. *Risk.*  The non-negative risk with the class prior p is p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive));
   while the second part is negative, steps undo it instead.  With the logistic loss the sum of weights is an estimate
   of the log odds.  p is the share of toxic among all labelled training documents.
3. *Training.*  ``MODELS`` tasks each draw, by hash, about ``MOST_POSITIVE`` confirmed and ``MOST_UNLABELLED`` training
   documents at most and minimise the risk on them; the models' mean is the start.  ``ROUNDS`` times the risk and its slope
   at the mean are then summed over *all* unlabelled documents, in their partitions, and each task minimises its own risk
   plus the plane by which the whole risk differs from it there.  At rest the slope of the whole risk is zero: the draws
   serve as its curvature only.
4. *Scores.*  Every text is scored whole by 1 / (1 + exp(-sum of its features' weights - bias)).

The only sample of the data that the fit stands on is one of labelled rows: of more than ``MOST_CONFIRMED`` confirmed ids,
about so many are drawn by hash.  They are broadcast, so no text is shuffled to find them, however many labels there are.

Labels are read for the training fold only: crc32(doc_id as text) mod 3 other than 1.

Results for odd input: null and empty texts have no features and get the score of the bias; rows with a null ``doc_id``
are training text without a label; an id that is labelled twice is toxic if any label says so; null labels are none;
without any confirmed document every score is 0; rows that come twice get the same score; an empty table gives an empty
result; columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import BASES, BYTE_CODES, Words, distinct_sorted, materialize, ranges_hash, text_bytes, text_chunks

GRAMS = (4, 5)
BUCKETS = 1 << 20
FEATURES = 4096
MODELS, MOST_POSITIVE, MOST_UNLABELLED, ROUNDS = 3, 3_000, 9_000, 2
MOST_CONFIRMED = 100_000
ROWS = 2_000
STEPS, RATE, DECAY = 300, 0.05, 1e-3
LEAST_SCORE = 0.7
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word) of the different words of each text, and (word, bucket) of the features of each different word."""
    words = Words(*text_bytes(pc.utf8_lower(column)), breaks=BREAKS)
    code, lead, word = np.unique(words.code, return_index=True, return_inverse=True)
    doc, word = distinct_sorted(words.doc, word)
    start, end = words.start[lead], words.end[lead]
    # the different words once more, each between two spaces
    size = end - start + 2
    edge = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    of = np.repeat(np.arange(len(code)), size)
    flat = np.full(edge[-1], 32, dtype=np.uint8)
    inner = (place > 0) & (place < size[of] - 1)
    flat[inner] = words.data[(start[of] + place - 1)[inner]]
    bucket = [ranges_hash(BYTE_CODES[flat], edge[:-1], edge[1:], BASES[2])]
    owner = [np.arange(len(code))]
    codes = BYTE_CODES[flat]
    for n in GRAMS:
        at = np.flatnonzero(place + n <= size[of])
        bucket.append(ranges_hash(codes, at, at + n, BASES[1]))
        owner.append(of[at])
    return doc, word, np.concatenate(owner), (np.concatenate(bucket) >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for chunk in text_chunks(batches):
        doc, word, owner, bucket = features(chunk.column("text"))
        times = np.bincount(word, minlength=int(owner.max()) + 1 if len(owner) else 0)
        total += np.bincount(bucket, times[owner], minlength=BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _numbers(chosen: np.ndarray) -> np.ndarray:
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[chosen] = np.arange(len(chosen))
    return number


def _pick(chosen: np.ndarray):
    """The chosen features of each document: its number << 32 | how often it is in the document's different words."""
    number = _numbers(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            doc, word, owner, bucket = features(chunk.column("text"))
            own = number[bucket]
            owner, own = owner[own >= 0], own[own >= 0]
            order = np.argsort(owner, kind="stable")
            owner, own = owner[order], own[order]
            first, last = np.searchsorted(owner, word), np.searchsorted(owner, word, side="right")
            size = last - first
            flat = own[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            pair, times = np.unique(np.repeat(doc, size).astype(np.int64) << 32 | flat, return_counts=True)
            value = (pair & 0xFFFFFFFF) << 32 | times
            edge = np.searchsorted(pair >> 32, np.arange(len(chunk) + 1))
            out = chunk.drop_columns(["text"])
            yield out.append_column("features", pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(value)))

    return run


def _toxic_share(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _clean_loss(share: np.ndarray) -> np.ndarray:
    """Loss of the answer "not toxic"."""
    return -np.log1p(-np.minimum(share, 1 - 1e-12))


class Risk(NamedTuple):
    """R-(unlabelled) - p * R-(positive) at some weights, its slope, and the slope of p * R+(positive)."""

    rest: float
    d_rest: np.ndarray
    d_toxic: np.ndarray


def minimise(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, n_features: int,
             start: np.ndarray | None = None, whole: Risk | None = None) -> np.ndarray:
    """Weights and bias (last) of the linear classifier with the least non-negative risk (mean of the later steps).

    A document is given by its features as ``_pick`` makes them; they are taken ``ROWS`` documents at a time.
    ``whole`` is the risk of more documents at ``start``: the plane by which it differs there is added to the risk.
    """
    docs = positive + unlabelled
    n_p, n_u = len(positive), len(unlabelled)
    blocks = []
    for at in range(0, len(docs), ROWS):
        part = docs[at: at + ROWS]
        row = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])
        value = np.concatenate(part) if len(row) else np.zeros(0, dtype=np.int64)
        blocks.append((at, at + len(part), row, (value >> 32).astype(np.int32), (value & 0xFFFFFFFF).astype(np.float32)))

    def shares(w: np.ndarray) -> np.ndarray:
        return _toxic_share(np.concatenate([np.bincount(row, w[col] * times, minlength=b - a)
                                            for a, b, row, col, times in blocks]) + w[-1])

    def slopes(share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        clean = _clean_loss(share)
        return (clean[n_p:].mean() - prior * clean[:n_p].mean(),
                np.concatenate([-prior * share[:n_p] / n_p, share[n_p:] / n_u]),
                np.concatenate([prior * (share[:n_p] - 1) / n_p, np.zeros(n_u)]))

    def gradient(slope: np.ndarray) -> np.ndarray:
        out = np.zeros(n_features + 1)
        out[-1] = slope.sum()
        for a, b, row, col, times in blocks:
            out[:-1] += np.bincount(col, slope[a:b][row] * times, minlength=n_features)
        return out

    if start is None:
        start = np.zeros(n_features + 1)
        start[-1] = np.log(prior / (1 - prior))
    plane = Risk(0.0, np.zeros_like(start), np.zeros_like(start))
    if whole is not None:
        rest, d_rest, d_toxic = slopes(shares(start))
        plane = Risk(whole.rest - rest, whole.d_rest - gradient(d_rest), whole.d_toxic - gradient(d_toxic))
    w, first, second, mean = start.copy(), np.zeros_like(start), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, STEPS + 1):
        rest, d_rest, d_toxic = slopes(shares(w))
        if rest + plane.rest + plane.d_rest @ (w - start) >= 0:
            slope = gradient(d_toxic + d_rest) + plane.d_toxic + plane.d_rest
        else:
            slope = gradient(-d_rest) - plane.d_rest
        slope[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope ** 2
        rate = RATE * (1 - 0.9 * step / STEPS)
        w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        if 2 * step > STEPS:
            mean += w / (STEPS - STEPS // 2)
    return mean


def _train(prior: float, n_features: int, start: np.ndarray | None, whole: Risk | None):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [rows.loc[rows["positive"] == p, "features"].tolist() for p in (True, False)]
        if not own[0] or not own[1]:
            return pd.DataFrame({"model": [], "weights": []})
        return pd.DataFrame({"model": [int(key[0])], "weights": [minimise(*own, prior, n_features, start, whole).tolist()]})

    return run


def _slopes(chosen: np.ndarray, model: np.ndarray):
    """Sums over the texts of a task: for each feature, and 1 for the bias, its times and its times by the toxic share;
    under the next number, the loss."""
    number, n = _numbers(chosen), len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, by_share = np.zeros(n + 2), np.zeros(n + 2)
        for chunk in text_chunks(batches):
            doc, word, owner, bucket = features(chunk.column("text"))
            own = number[bucket]
            owner, own = owner[own >= 0], own[own >= 0]
            words = int(word.max()) + 1 if len(word) else 0
            by_word = np.bincount(owner, model[own], minlength=words)
            share = _toxic_share(np.bincount(doc, by_word[word], minlength=len(chunk)) + model[-1])
            times[:n] += np.bincount(own, np.bincount(word, minlength=words)[owner], minlength=n)
            by_share[:n] += np.bincount(own, np.bincount(word, share[doc], minlength=words)[owner], minlength=n)
            times[n] += len(chunk)
            by_share[n] += share.sum()
            by_share[n + 1] += _clean_loss(share).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 2)), pa.array(times), pa.array(by_share)],
                                         ["number", "times", "by_share"])

    return run


def whole_risk(confirmed: DataFrame, texts: DataFrame, chosen: np.ndarray, model: np.ndarray, prior: float) -> Risk:
    """The risk at ``model`` over every row of both tables, summed in their partitions."""
    sums = []
    for rows in (confirmed, texts):
        one = (rows.select("text").mapInArrow(_slopes(chosen, model), "number long, times double, by_share double")
               .groupBy("number").agg(F.sum("times").alias("times"), F.sum("by_share").alias("by_share")).toPandas())
        one = one.sort_values("number")  # as many rows as features
        sums.append((one["times"].to_numpy(), one["by_share"].to_numpy()))
    n = len(chosen)
    (times_p, share_p), (times_u, share_u) = sums
    n_p, n_u = times_p[n], times_u[n]
    return Risk(share_u[n + 1] / n_u - prior * share_p[n + 1] / n_p,
                share_u[: n + 1] / n_u - prior * share_p[: n + 1] / n_p,
                prior * (share_p[: n + 1] - times_p[: n + 1]) / n_p)


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            doc, word, owner, bucket = features(chunk.column("text"))
            by_word = np.bincount(owner, weights[bucket], minlength=int(owner.max()) + 1 if len(owner) else 0)
            f = np.bincount(doc, by_word[word], minlength=len(chunk)) + bias
            out = chunk.drop_columns(["text"])
            yield out.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(f, -700, 700)))))

    return run


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[np.ndarray, float] | None:
    """Weight of each bucket and bias; None without a confirmed document.  ``train`` tells a training row by doc_id."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(train)
    marks = (labels.where("doc_id is not null and toxic is not null").where(train)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    seen = marks.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    if not seen["toxic"]:
        return None
    prior = min(0.99, seen["toxic"] / seen["n"])
    chance = int((1 << 30) * min(1.0, MOST_CONFIRMED / seen["toxic"]))
    toxic = marks.where((F.col("toxic") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit(MODELS)), F.lit(1 << 30)) < chance))
    # about MOST_CONFIRMED ids at most
    confirmed = materialize(texts.join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_semi"), "confirmed")
    n_p, n_u = confirmed.count(), texts.count()
    if not n_p:
        return None

    counted = [materialize(rows.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket")
                           .agg(F.sum("n").alias(name)), "counts") for rows, name in ((confirmed, "p"), (texts, "u"))]
    rate_p, rate_u = F.col("p") / n_p, F.col("u") / n_u
    chosen = (counted[0].join(counted[1], "bucket")
              .withColumn("far", F.abs(rate_p - rate_u) / F.sqrt((rate_u + 1.0 / n_u) / n_p))
              .orderBy(F.desc("far"), "bucket").limit(FEATURES).select("bucket").collect())
    chosen = np.array(sorted(r["bucket"] for r in chosen))

    def drawn(n: int, most: int) -> Column:
        """The models that learn from a row."""
        chance = int((1 << 30) * min(1.0, most / n))
        return F.filter(F.array(*[F.lit(m) for m in range(MODELS)]),
                        lambda m: F.pmod(F.xxhash64("doc_id", F.length("text"), m), F.lit(1 << 30)) < chance)

    sample = (confirmed.withColumns({"models": drawn(n_p, MOST_POSITIVE), "positive": F.lit(True)})
              .unionByName(texts.withColumns({"models": drawn(n_u, MOST_UNLABELLED), "positive": F.lit(False)}))
              .where(F.size("models") > 0).drop("doc_id"))
    picked = materialize(sample.mapInArrow(_pick(chosen), "models array<int>, positive boolean, features array<long>"), "drawn")
    picked = picked.select(F.explode("models").alias("model"), "positive", "features")
    mean = whole = None
    for _ in range(1 + ROUNDS):
        if mean is not None:
            whole = whole_risk(confirmed, texts, chosen, mean, prior)
        models = (picked.groupBy("model").applyInPandas(_train(prior, len(chosen), mean, whole), "model long, weights array<double>")
                  .collect())  # MODELS rows
        if not models:
            return None
        mean = np.mean([m["weights"] for m in models], axis=0)
    weights = np.zeros(BUCKETS)
    weights[chosen] = mean[:-1]
    return weights, float(mean[-1])


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs``."""
    train = ~F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))
    learned = learn(docs, labels, train)
    rows = docs.select("doc_id", (~train).alias("held_out"), F.col("text").cast("string").alias("text"))
    if learned is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    return rows.mapInArrow(_score(*learned), "doc_id long, held_out boolean, score double")


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score(read("documents").select("doc_id", "text"), read("labels").select("doc_id", "toxic")).withColumn(
        "predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
