"""Mixing sources to target weights (operator 2): Poisson replication.

A source that has the size s (characters) and the target weight w gets the mean repetition rate w / sum(w) * total / s.
Every document is repeated as often as a Poisson variable of that mean says, which is found by inverting its
distribution function at a uniform number that depends on the seed and the id only: the same document gets the same
number of copies in every run and on every cluster.  The copies are then shuffled globally: an even hash deals them
over all partitions, a hashed key orders them within.

Without weights, the target weight of a source is the square root of its size (temperature 2).  Rates are kept in a
table with one row per source; Spark broadcasts it if its files are small and else splits a hot source in the join.

Results for odd input: a null source is a source of its own; a null text has the size 0; sources without any text or
with the weight 0 (or none in the weights table) give no copies; documents without an id are drawn by their texts, those
with equal texts alike; a row that comes twice is drawn twice alike; an empty table gives an empty result; columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import materialize

SEED = "mix-1"
#: A larger mean is split into equal parts, each inverted with a uniform number of its own (their sum has that mean).
LARGEST_MEAN = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """(source_key, rate) for every source of ``docs``; ``weights`` has the columns source and weight."""
    sizes = docs.groupBy(_source_key()).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt("size"))
    else:
        given = weights.groupBy(_source_key()).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(given, "source_key", "left").fillna(0.0, ["weight"])
    sizes = materialize(sizes, "sizes")
    all_of = sizes.where("size > 0").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    goal = total if total is not None else float(all_of["size"] or 0)
    rate = F.lit(goal) * F.col("weight") / F.lit(all_of["weight"] or 1.0) / F.col("size")
    return sizes.select("source_key", F.when((F.col("size") > 0) & (F.col("weight") > 0), rate).otherwise(0.0).alias("rate"))


def _source_key() -> Column:
    """Null apart from every text, the empty one included."""
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key")


def _ident() -> Column:
    """What a document is drawn by: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))


def with_thresholds(rates: DataFrame) -> DataFrame:
    """Adds parts (into which the mean is split) and cdf: P(N <= k) of one part for k = 0, 1, ..."""
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return (rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
            .withColumn("cdf", step))


def poisson_replicate(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED,
                      total: float | None = None) -> DataFrame:
    """The copies of ``docs`` in random order, with ``copy`` (1, 2, ...) and ``shuffle_key``."""
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = materialize(with_thresholds(source_rates(docs, weights, total)), "rates").where("rate > 0").select(
        F.col("source_key").alias("__source"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    ident = _ident()
    numbers = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda i: uniform(F.lit(seed), ident, i.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter("__cdf", lambda c: c <= u)))
    copies = (docs.select(*names).withColumn("__source", _source_key()).join(rates, "__source")
              .withColumn("__n", drawn).where("__n > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names, "copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sources_query(spark, sf_dir: str) -> DataFrame:
    return poisson_replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH s AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
a AS (SELECT sum(size)::DOUBLE AS size, sum(sqrt(size)) AS weight FROM s WHERE size > 0),
r AS (SELECT s.source, a.size * sqrt(s.size) / a.weight / s.size AS rate FROM s, a WHERE s.size > 0),
m AS (SELECT source, rate, greatest(1, ceil(rate / 64))::BIGINT AS parts FROM r),
k AS (SELECT source, parts, rate / parts AS mean, unnest(range(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 30)::BIGINT + 1)) AS k FROM m),
c AS (SELECT source, parts, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
t AS (SELECT source, any_value(parts) AS parts, list(cdf) AS cdf FROM c GROUP BY source),
u AS (SELECT d.*, t.cdf, unnest(range(1, t.parts + 1)) AS i FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT doc_id, text, lang, source, n_chars, sum(len([x FOR x IN cdf IF x <= ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || i), 1, 13))::BIGINT / 4503599627370496.0]))::BIGINT AS n
      FROM u GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('mix-1:order:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || copy) AS shuffle_key FROM e
"""
