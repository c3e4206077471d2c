"""Language identification (operator 3): Bayesian fusion of text, declared language, address suffix and host.

1. *Text likelihoods.*  Letter trigrams (UTF-8 bytes, lower-cased, hashed into ``BUCKETS``) are counted by declared
   language over the whole table; the counts of ``languages`` make a multinomial model (a bounded table).  Trigrams
   overlap, so the log likelihood of a text counts for a third, and for at most ``MOST`` trigrams.
2. *Evidence about the document.*  Rows whose text alone is decisive vote.  Grouped votes give P(declared | language)
   and P(suffix | language), smoothed towards the share of the value, and the prior of the host, smoothed towards its
   parent domain, which is smoothed towards all rows; a row's own vote is taken out of its host's prior.
3. *Fusion.*  The language with the largest product of the four is the answer, its share the confidence.  A row is
   rejected (kept = false) if its text has no letter or the confidence is below ``LEAST_CONFIDENCE``.

Results for odd input: null and empty texts and texts without letters have no language and are rejected; a missing
declared language, suffix or host says nothing; declared values outside ``languages`` train no model but are evidence
like any value; ties go to the first of ``languages``; rows that come twice get the same answer each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import NULL_KEY, doc_key, materialize, text_bytes, text_chunks

LANGUAGES = ("en", "fr", "de", "es")
BUCKETS = 1 << 15
MOST, WEIGHT = 300, 1 / 3
SMOOTHING = 0.5
DECISIVE, LEAST_VOTE = 0.99, 30
STRENGTH = 10.0
LEAST_CONFIDENCE = 0.6
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = 1


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the trigrams with two letter bytes at least; other bytes count as a space."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    letter = _LETTER[data]
    code = np.where(letter == 1, data, 32).astype(np.uint32)
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = code[:-2] << 16 | code[1:-1] << 8 | code[2:]
    ok = (letter[:-2] + letter[1:-1] + letter[2:] >= 2) & (doc[:-2] == doc[2:])
    return doc[:-2][ok], ((x[ok] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _count(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
        for chunk in text_chunks(batches):
            lang = np.asarray(pc.fill_null(pc.index_in(chunk.column("declared"), pa.array(languages)), -1))
            doc, bucket = trigrams(chunk.column("text"))
            of = lang[doc]
            total += np.bincount(of[of >= 0] * BUCKETS + bucket[of >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def _score(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            doc, bucket = trigrams(chunk.column("text"))
            n = np.bincount(doc, minlength=len(chunk))
            weight = WEIGHT * np.minimum(1.0, MOST / np.maximum(n, 1))
            like = [np.bincount(doc, row[bucket], minlength=len(chunk)) * weight for row in model]
            out = chunk.drop_columns(["text"]).append_column("n_trigrams", pa.array(n, pa.int64()))
            flat = pa.array(np.stack(like, axis=1).ravel())
            yield out.append_column("loglik", pa.ListArray.from_arrays(
                np.arange(0, len(flat) + 1, len(model), dtype=np.int32), flat))

    return run


def _shares(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
    return [F.exp(x - top) / total for x in logs]


def identify(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, declared: Column | None = None,
             host: Column | None = None, parent: Column | None = None, suffix: Column | None = None,
             key: Column | None = None) -> DataFrame:
    """(key, text_hash, language, confidence, kept, declared, n_trigrams) for every row of ``docs`` (text, ...).

    By default the table is ``documents``: its lang is what is declared and its source is the host.
    """
    text = F.col("text").cast("string")
    nothing = F.lit(None).cast("string")
    pick = lambda given, name: (given if given is not None
                                else F.col(name).cast("string") if name in docs.columns else nothing)
    rows = docs.select(
        (key if key is not None else doc_key()).alias("key"), F.xxhash64(text).alias("text_hash"),
        F.lower(F.substring_index(pick(declared, "lang"), "-", 1)).alias("declared"),
        pick(suffix, "").alias("suffix"), pick(host, "source").alias("host"), pick(parent, "").alias("parent"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))

    counts = np.zeros(len(languages) * BUCKETS)
    for cell, n in (rows.select("declared", "text").mapInArrow(_count(languages), "cell long, n long")
                    .groupBy("cell").agg(F.sum("n")).collect()):  # at most languages x BUCKETS rows
        counts[cell] = n
    counts = counts.reshape(len(languages), BUCKETS) + SMOOTHING
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    schema = ("key long, text_hash long, declared string, suffix string, host string, parent string, letters boolean, "
              "n_trigrams long, loglik array<double>")
    evidence = materialize(rows.mapInArrow(_score(model), schema), "evidence")

    k = range(len(languages))
    by_text = _shares([F.col("loglik")[i] for i in k])
    votes = [((share > DECISIVE) & (F.col("n_trigrams") >= LEAST_VOTE)).cast("long") for share in by_text]
    evidence = evidence.withColumn("vote", F.array(*votes))
    sums = [F.sum(F.col("vote")[i]).alias(f"n{i}") for i in k]

    def grouped(name: str) -> DataFrame:
        return materialize(evidence.where(F.col(name).isNotNull()).groupBy(name).agg(*sums)
                           .select(name, F.array(*[F.col(f"n{i}") for i in k]).alias(f"{name}_n")), "votes")

    total = evidence.agg(*sums).first()
    total = [float(x or 0) for x in total]
    whole = sum(total)
    logs = []
    for i in k:
        share_of_all = (total[i] + 1) / (whole + len(languages))
        at_host = F.coalesce(F.col("host_n")[i] - F.col("vote")[i], F.lit(0))
        host_size = F.coalesce(F.aggregate("host_n", F.lit(0).cast("long"), lambda a, x: a + x)
                               - F.aggregate("vote", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
        at_parent = F.coalesce(F.col("parent_n")[i], F.lit(0))
        parent_size = F.coalesce(F.aggregate("parent_n", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
        above = (at_parent + STRENGTH * share_of_all) / (parent_size + STRENGTH)
        log = F.col("loglik")[i] + F.log((at_host + STRENGTH * above) / (host_size + STRENGTH))
        for name in ("declared", "suffix"):
            size = F.aggregate(f"{name}_n", F.lit(0).cast("long"), lambda a, x: a + x)
            likely = (F.col(f"{name}_n")[i] + STRENGTH * (size + 1) / (whole + 1)) / (total[i] + STRENGTH)
            log = log + F.coalesce(F.log(likely), F.lit(0.0))
        logs.append(log)
    fused = evidence
    for name in ("declared", "suffix", "host", "parent"):
        fused = fused.join(grouped(name), name, "left")
    fused = fused.withColumn("share", F.array(*_shares(logs)))
    best = F.array_max("share")
    known = F.col("letters")
    return fused.select(
        "key", "text_hash",
        F.when(known, F.element_at(F.array(*map(F.lit, languages)), F.array_position("share", best).cast("int"))).alias("language"),
        F.when(known, best).otherwise(0.0).alias("confidence"),
        (known & (best >= LEAST_CONFIDENCE)).alias("kept"), "declared", "n_trigrams")


def with_language(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` without the rejected rows, and with lang as identified."""
    found = materialize(identify(docs, languages), "languages")
    changed = (found.where(~F.col("kept") | ~F.col("language").eqNullSafe(F.col("declared")))
               .select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("language").alias("__language"),
                       F.col("kept").alias("__kept")).distinct())
    changed = materialize(changed, "changed")
    return (docs.withColumns({"__key": doc_key(), "__hash": F.xxhash64(F.col("text").cast("string"))})
            .join(changed, ["__key", "__hash"], "left").where("coalesce(__kept, true)")
            .withColumn("lang", F.coalesce("__language", "lang")).select(*docs.columns))


def language_id_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify(docs).select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "language", "confidence", "kept", "declared", "n_trigrams")


def page_language_query(spark, sf_dir: str) -> DataFrame:
    """The same for ``pages``: declared markup language, address suffix, host and its parent domain."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    host = F.when(host != "", host)
    markup = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    return identify(
        pages.select("page_id", "url", "html", body.alias("text")), declared=F.when(markup != "", markup), host=host,
        parent=F.substring_index(host, ".", -2), suffix=F.substring_index(host, ".", -1), key=F.col("page_id").cast("long"),
    ).select(F.col("key").alias("page_id"), "language", "confidence", "kept", "declared", "n_trigrams")
