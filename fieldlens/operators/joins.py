"""Join operators.

A lookup in a dimension whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` is a plain equi-join, which Spark
broadcasts.  Beyond that size it is a shuffle join, and AQE does not split a
hot key there, because the dimension is a grouped table; ``join_dimension``
spreads the rows of hot keys instead.  An explicit ``broadcast`` hint is used
only for fixed tiny tables and for the rows of at most ``HOT_KEYS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import expr as E


def shared(df: DataFrame) -> DataFrame:
    """``df`` as it is, for a plan that reads it several times.  The rows pass
    through an explode, under which the filters and unused columns of one
    branch are not pushed, so all branches need the same joins and shuffles,
    and Spark runs those once (exchange reuse) instead of once for each."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def last_value(dim: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One value per key: the last row wins, by the ``order`` column if there
    is one, else by the order in which the rows are read.  A row without a
    value replaces nothing.  Combined map-side, so a key that comes very often
    is reduced inside each task."""
    rows = dim.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    place = F.col(order) if order else F.monotonically_increasing_id()
    return (rows.select(key, value, place.alias("_place")).groupBy(key)
            .agg(F.max(F.struct("_place", F.col(value).alias("_value"))).alias("_last"))
            .select(key, F.col("_last._value").alias(value)))


#: A key is hot from this share of all rows on; the sketch follows so many candidates, of which so many count.
HOT_SHARE, HOT_TRACKED, HOT_KEYS = 1 / 512, 8192, 512
#: Rows of hot keys and without a key are dealt to so many places, which is far more than there are tasks.
PLACES = 1 << 16


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size of ``df`` is below Spark's broadcast threshold."""
    state = df.sparkSession._jsparkSession.sessionState()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= state.conf().autoBroadcastJoinThreshold()


def hot_keys(df: DataFrame, on: str, share: float = HOT_SHARE) -> DataFrame:
    """At most ``HOT_KEYS`` rows: the values of ``on`` (column ``_hot``) with
    at least about ``share`` of all rows, by a mergeable frequent-items sketch."""
    top = F.call_function("approx_top_k", F.col(on), F.lit(HOT_KEYS), F.lit(HOT_TRACKED))
    found = df.select(on).agg(top.alias("_top"), F.count(F.lit(1)).alias("_n"))
    hot = F.filter("_top", lambda x: x["item"].isNotNull() & (x["count"] >= F.col("_n") * F.lit(share)))
    return found.select(F.explode(hot).alias("_x")).select(F.col("_x.item").alias("_hot"))


def join_dimension(df: DataFrame, dim: DataFrame, on: str, key: str, spread: list[str] | None = None) -> DataFrame:
    """Left join of ``df`` with ``dim``, which has at most one row per ``key``:
    the columns of ``df`` and those of ``dim`` but the key.  Every row of
    ``df`` stays.

    A small dimension is left to Spark.  Else the rows of hot keys are found
    by a sketch; their few dimension rows go to all tasks, and they and the
    rows without a key are dealt by a hash of the ``spread`` columns, where
    they match nothing.  All other rows are joined by key.  Without ``spread``
    it is a hash of the whole row, for which all shuffles before this one carry
    every column of ``df``, used later or not: a table with row keys gives those.
    """
    names = [c for c in dim.columns if c != key]
    if fits_broadcast(dim):
        return df.join(dim.withColumnRenamed(key, "_dk"), df[on] == F.col("_dk"), "left").select(*df.columns, *names)
    packed = dim.select(F.col(key).alias("_dk"), F.struct(*names).alias("_dv"))
    hot = hot_keys(df, on)
    hot = hot.join(packed, hot["_hot"] == packed["_dk"], "left").select("_hot", F.col("_dv").alias("_hv"))
    rows = df.join(F.broadcast(hot), df[on] == hot["_hot"], "left")  # at most HOT_KEYS rows
    apart = F.col("_hot").isNotNull() | F.col(on).isNull()
    place = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(PLACES))  # noqa: E731  # a small number is shuffled in few bytes
    rows = rows.withColumns({"_lk": F.when(~apart, F.col(on)),
                             "_lh": F.when(apart, place(*(spread or df.columns))).otherwise(place(on))})
    right = packed.withColumn("_dh", place("_dk"))
    joined = rows.join(right, (rows["_lh"] == right["_dh"]) & (rows["_lk"] == right["_dk"]), "left")
    value = F.coalesce("_hv", "_dv")
    return joined.select(*df.columns, *[value[n].alias(n) for n in names])


def lookup(df: DataFrame, on: str, dim: DataFrame, out: str, default: str | None = "",
           key: str = "raw", value: str = "label", order: str | None = None, spread: list[str] | None = None) -> DataFrame:
    """Left lookup ``df[on]`` -> ``dim[value]`` as column ``out``; unmatched -> ``default``; ``spread`` as in ``join_dimension``."""
    d = last_value(dim, key, value, order).select(F.col(key).alias("_key"), F.col(value).alias("_label"))
    j = join_dimension(df, d, on, "_key", spread)
    v = F.col("_label") if default is None else F.coalesce(F.col("_label"), F.lit(default))
    cols = [c for c in df.columns if c != out]
    return j.select(*cols, v.alias(out))


def lookups(df: DataFrame, on: str, dims: dict[str, DataFrame], default: str = "", key: str = "raw",
            value: str = "label", spread: list[str] | None = None) -> DataFrame:
    """Several lookups of one column ``on`` as one join: ``{output column:
    dimension}``; an output may replace ``on`` itself; ``spread`` as in ``join_dimension``."""
    tagged = [last_value(d, key, value).select(F.col(key).alias("_key"), F.lit(out).alias("_out"), F.col(value).alias("_label"))
              for out, d in dims.items()]
    every = tagged[0]
    for one in tagged[1:]:
        every = every.unionByName(one)
    wide = every.groupBy("_key").agg(*[F.max(F.when(F.col("_out") == out, F.col("_label"))).alias(f"_l_{out}") for out in dims])
    j = join_dimension(df, wide, on, "_key", spread)
    cols = [c for c in df.columns if c not in dims]
    return j.select(*cols, *[F.coalesce(F.col(f"_l_{out}"), F.lit(default)).alias(out) for out in dims])


def not_yet_processed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose trimmed key tuple is not in ``done``."""
    def norm(frame: DataFrame, prefix: str) -> list[Column]:
        return [E.strip(F.coalesce(frame[k].cast("string"), F.lit(""))).alias(f"{prefix}{i}") for i, k in enumerate(keys)]
    d = done.select(*norm(done, "_d")).distinct()
    left = df.select("*", *norm(df, "_l"))
    cond = None
    for i in range(len(keys)):
        e = left[f"_l{i}"] == d[f"_d{i}"]
        cond = e if cond is None else cond & e
    return left.join(d, cond, "left_anti").select(*df.columns)


def ticket_numbers_per_unit(tickets: DataFrame, serial: str = "CHASSI", ss: str = "SS") -> DataFrame:
    """The serial -> ticket-number relation as distinct (serial, SS) pairs.

    Kept as a pair table rather than a collected list, so a unit with a huge
    number of tickets is never gathered into a single row or task.
    """
    return tickets.where(F.col(serial).isNotNull() & F.col(ss).isNotNull()).select(serial, ss).distinct()
