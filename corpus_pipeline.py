"""A training corpus from ``documents``: language, near duplicates, repeated passages, benchmark leaks, mixture.

``run`` applies ``STAGES`` in turn.  Each stage takes what its predecessor kept, written as Parquet in the shared
folder and read again; all but the last return the columns of ``documents``.

* ``language``: rows without a determined language go; lang is what was identified.
* ``near_duplicates``: of each class of documents linked by 5-word Jaccard similarity >= 0.8 the smallest id stays.
* ``repeated_passages``: words covered by a repeated 20-word window go; a text without repeats stays as it is, byte by
  byte; a document that has nothing left goes, n_chars is counted anew.
* ``benchmark_leaks``: documents that cover at least half the tokens of a ``benchmark`` item go.
* ``mixture``: Poisson replication to the target weights, shuffled globally; adds copy and shuffle_key.

Null, empty and repeated rows are treated as the operators' docstrings say; columns besides those of ``documents`` are
carried through.  SQL cannot express the tiling and the trained models, so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` compares the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import language, mixing, ngram_join, substring, tiling
from fieldlens.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")  # whatever the other columns are called
    cut = substring.remove_repeats(docs.select("doc_id", "text", whole)).where("n_removed = 0 or n_removed < n_words")
    cut = cut.select("row.*", F.when(F.col("n_removed") > 0, F.col("kept_text")).alias("__text"))
    new = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("__text").cast("long"), "n_chars")
    return cut.withColumns(new).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_replicate(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
