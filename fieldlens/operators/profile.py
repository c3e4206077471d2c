"""Table profile (S17): one aggregation pass, output in long format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import expr as E


def table_profile(df: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Per column: type, rows, null count, distinct count and three sample
    values (the smallest, the most frequent and the greatest, as text).

    The exact form counts every (column, value) pair once, combined map-side,
    and then the pairs of a column; a value that fills a third of the table is
    one row after each task.  ``exact=False`` uses HyperLogLog sketches
    (``approx_count_distinct``, relative error ``rsd``) and gives no samples:
    one fixed-size sketch per column and task instead of shuffling every
    distinct value, the usual choice for wide tables at large scale.
    """
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    if exact:
        pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("coluna"), F.col(f"`{f.name}`").cast("string").alias("valor"))
                                    for f in df.schema.fields])).alias("r")
        counts = df.select(pairs).groupBy("r.coluna", "r.valor").agg(F.count(F.lit(1)).alias("n"))
        known = F.when(F.col("valor").isNotNull(), F.struct("n", "valor"))
        return counts.groupBy("coluna").agg(
            F.sum("n").alias("linhas"), F.sum(F.when(F.col("valor").isNull(), F.col("n")).otherwise(0)).alias("nulos"),
            F.count("valor").alias("distintos"), F.min("valor").alias("exemplo_menor"),
            F.max(known)["valor"].alias("exemplo_frequente"), F.max("valor").alias("exemplo_maior"),
        ).select("coluna", types[F.col("coluna")].alias("tipo"), "linhas", "nulos", "distintos",
                 "exemplo_menor", "exemplo_frequente", "exemplo_maior")
    aggs = [F.count(F.lit(1)).alias("linhas")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"n__{f.name}"), F.approx_count_distinct(c, rsd).alias(f"d__{f.name}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("coluna"), F.lit(f.dataType.simpleString()).alias("tipo"), F.col("linhas"),
                              F.col(f"`n__{f.name}`").alias("nulos"), F.col(f"`d__{f.name}`").alias("distintos"))
                     for f in df.schema.fields])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def date_rejects(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column that should hold dates: rows, blank ones, and those
    that hold text which is no date (they drop out of every yearly report)."""
    sums = []
    for c in columns:
        blank = F.col(c).isNull() | (E.strip(F.col(c).cast("string")) == "")
        sums += [F.count_if(blank).alias(f"{c}|b"), F.count_if(~blank & E.parse_day_first(c).isNull()).alias(f"{c}|r")]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col("_n").alias("linhas"), F.col(f"{c}|b").alias("vazias"),
                              F.col(f"{c}|r").alias("rejeitadas")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")
