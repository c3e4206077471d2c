"""Exact medians of groups of any size (W3 and the cut-offs of A14 and A16).

``median`` keeps all different values of a group in one task.  Here a group
is narrowed instead: its values are counted in ``BINS`` equal parts of the
range that holds the wanted rank, the prefix counts name the part that holds
it, and that part becomes the range.  After ``LEVELS`` rounds only the values
of the last part are put in order.  Equal values are one row with a count
from the start, so a value that fills the group costs nothing; a task sorts at
most ``BINS`` rows of a group, and in the end the different values within one
part in ``BINS ** LEVELS`` of the range (uneven values: more, never wrong).

Groups must be few (months, kinds of value, or none): the ranges, two rows per
group and column, are broadcast.  Null values and NaN are not counted; a group
without values has no row.  An even group gives the mean of its middle two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, LEVELS = 1024, 2
_RANK = ("_rank", "_lo", "_hi", "_before")


def _holding(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The row of each (group, rank) whose counts, in order, pass the rank; ``_before`` becomes what precedes it."""
    upto = F.sum("_n").over(Window.partitionBy(*group, "_rank").orderBy(order)
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("_before") + F.col("_upto") - F.col("_n")
    return (rows.withColumn("_upto", upto).withColumn("_start", start)
            .where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_n"))))


def medians(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per group of ``keys``, the median of each of ``columns`` (column -> name of its median)."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)  # equal as a whole, nulls as well
    values = F.array(*[F.struct(F.lit(name).alias("_of"), F.col(c).cast("double").alias("_v")) for c, name in columns.items()])
    group = ["_key", "_of"]
    counts = (df.select(key.alias("_key"), F.explode(values).alias("_x")).select("_key", "_x._of", "_x._v")
              .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranges = total.select(*group, F.explode(F.array_distinct(F.array(
        F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))).alias("_rank"),
        "_lo", "_hi", F.lit(0).cast("long").alias("_before"))

    def within(ranges: DataFrame) -> DataFrame:
        r = ranges.select(F.col("_key").alias("_rkey"), F.col("_of").alias("_rof"), *_RANK)
        return counts.join(F.broadcast(r), F.expr("_key <=> _rkey AND _of = _rof AND _v >= _lo AND _v <= _hi")).drop("_rkey", "_rof")

    for _ in range(LEVELS):
        # half the distance: that of the largest doubles would not fit
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.when(F.col("_hi") / 2 > F.col("_lo") / 2, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        parts = (within(ranges).groupBy(*group, "_rank", "_before", part.alias("_part"))
                 .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        ranges = _holding(parts, group, "_part").select(*group, "_rank", "_lo", "_hi", F.col("_start").alias("_before"))
    middle = _holding(within(ranges), group, "_v").groupBy(*group).agg(F.avg("_v").alias("_m"))
    wide = middle.groupBy("_key").agg(*[F.max(F.when(F.col("_of") == n, F.col("_m"))).alias(n) for n in columns.values()])
    return wide.select(*[F.col("_key")[k].alias(k) for k in keys], *columns.values())
