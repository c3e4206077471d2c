"""Incremental updates with a persisted low-water mark.

The watermark is the date of the oldest open ticket; every step is
rerun-safe: appends skip keys already present (anti join) and overwrites go
to a new versioned path, never to the path being read.
"""

from __future__ import annotations

import datetime as dt
import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions import dims
from fieldlens.functions import expr as E
from fieldlens.operators import dedup, joins
from fieldlens.streaming.published import Published


def oldest_open(tickets: DataFrame, as_of: dt.date, date_col: str = "DATA") -> DataFrame:
    """One row, the date of the oldest open ticket (``as_of`` if none)."""
    return tickets.agg(F.coalesce(
        F.min(F.when(F.upper("STATUS") == dims.STATUS_OPEN, F.col(date_col).cast("date"))),
        E.as_of_lit(as_of)).alias("oldest_open"))


def month_ranges(watermark: DataFrame, as_of: dt.date, col: str = "oldest_open") -> DataFrame:
    """M1: calendar months from the watermark to ``as_of`` as (inicio, fim),
    clipped to the watermark and to ``as_of``."""
    end = E.as_of_lit(as_of)
    months = F.explode(F.sequence(F.trunc(F.col(col), "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH")))
    m = watermark.select(F.col(col).alias("_w"), months.alias("mes"))
    return m.select("mes", F.greatest("mes", "_w").alias("inicio"), F.least(F.last_day("mes"), end).alias("fim"))


def resplit(tickets: DataFrame, watermark: DataFrame, date_col: str = "DATA",
            col: str = "oldest_open") -> DataFrame:
    """M2: tag each ticket 'historico' (not open, a null status included, and
    older than the watermark) or 'atual' (on/after the watermark); null dates
    go to neither."""
    j = tickets.crossJoin(F.broadcast(watermark.select(F.col(col).alias("_w"))))  # one-row frame
    d = F.col(date_col).cast("date")
    dest = (F.when(d.isNull(), F.lit(None))
            .when(~F.upper("STATUS").eqNullSafe(dims.STATUS_OPEN) & (d < F.col("_w")), "historico")
            .when(d >= F.col("_w"), "atual"))
    return j.withColumn("destino", dest).drop("_w")


def append_new(target: DataFrame | None, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not yet in ``target``."""
    if target is None:
        return incoming
    return joins.not_yet_processed(incoming, target, keys)


def merge_history(history: DataFrame | None, closed: DataFrame, keys: list[str], order) -> DataFrame:
    """Q13: history union new closed rows, deduplicated (latest wins) so a
    rerun adds nothing."""
    allrows = closed if history is None else history.unionByName(closed, allowMissingColumns=True)
    return dedup.latest_per_key(allrows, keys, order)


def write_version(df: DataFrame, base_path: str, version: str, fmt: str = "parquet") -> str:
    """Write to ``base_path/v=<version>`` (overwrite of that version only)."""
    path = os.path.join(base_path, f"v={version}")
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet.  Any other
    failure (no permission, broken files, time-out) is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


WATERMARK = "oldest_open date, written_at timestamp"


def read_watermark(spark: SparkSession, path: str, default: dt.date) -> DataFrame:
    """The watermark written last (one row), or ``default`` when none was written."""
    first = F.lit(default).cast("date")
    stored = read_if_present(spark, path, WATERMARK)
    if stored is None:
        return spark.range(1).select(first.alias("oldest_open"))
    return stored.agg(F.coalesce(F.max_by("oldest_open", "written_at"), first).alias("oldest_open"))


def write_watermark(watermark: DataFrame, path: str) -> None:
    """Adds the new watermark; earlier ones stay, so a crash while writing loses nothing."""
    (watermark.select("oldest_open", F.current_timestamp().alias("written_at"))
     .coalesce(1).write.mode("append").parquet(path))


#: Where a row came from, the later source the greater number.
FROM_HISTORY, FROM_BASE, FROM_REPORT = 0, 1, 2


def latest_arrival(tickets: DataFrame, base: DataFrame | None, keys: list[str], order) -> DataFrame:
    """One row per ticket: a newly fetched row before a base row, whatever
    their dates (a ticket that was reopened, closed or reassigned keeps its
    opening date), then by ``order``."""
    if base is None:
        return dedup.latest_per_key(tickets, keys, order)
    every = (tickets.withColumn("_from", F.lit(FROM_REPORT))
             .unionByName(base.withColumn("_from", F.lit(FROM_BASE)), allowMissingColumns=True))
    return dedup.latest_per_key(every, keys, [F.col("_from"), *order]).drop("_from")


def update_tickets(tickets: DataFrame, base: DataFrame | None, history: DataFrame | None, as_of: dt.date,
                   keys: list[str], order, date_col: str = "DATA") -> dict[str, DataFrame]:
    """The nightly update over already fetched report rows.

    The new rows and the current base make one table with one row per key,
    the newly fetched one first; its oldest open ticket is the new watermark;
    older closed rows move to the history, the rest stays current and rows
    without a date are returned as rejects.  A history row whose key arrives
    again (a reopened ticket) gives way to the new row, wherever that goes.
    All frames are lazy; ``run_update`` keeps them in a table on storage.
    """
    every = latest_arrival(tickets, base, keys, order)
    watermark = oldest_open(every, as_of, date_col)
    split = resplit(every, watermark, date_col)
    part = lambda name: split.where(F.col("destino") == name).drop("destino")
    kept = None if history is None else not_among(history, every, keys)
    return {
        "watermark": watermark,
        "history": merge_history(kept, part("historico"), keys, order),
        "current": part("atual"),
        "rejects": split.where(F.col("destino").isNull()).drop("destino"),
    }


def not_among(df: DataFrame, others: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose key (nulls equal) is not in ``others`` (``left_semi``: is in it)."""
    o = others.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(o[f"_o{i}"]) for i, k in enumerate(keys)])
    return df.join(o, same, how)


# ------------------------------------------------------- the nightly state
def _history(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("_arrival", T.LongType()), T.StructField("_year", T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], stored)
    return reduce(DataFrame.unionByName, [spark.read.schema(stored).parquet(f) for f in folders])


def _split(spark: SparkSession, folder: str | None, schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("_part", T.StringType())])
    return spark.read.schema(stored).parquet(folder) if folder else spark.createDataFrame([], stored)


def read_state(spark: SparkSession, root: str, schema: T.StructType, keys: list[str]) -> dict[str, DataFrame]:
    """The tables of the last complete ``run_update``: current, rejects and
    history (the row that arrived last per key; keys that are open or
    undated again are not in it)."""
    _, state = Published(spark, root).latest()
    split = _split(spark, state.get("split"), schema)
    names = [f.name for f in schema.fields]
    history = _history(spark, state.get("history", []), schema).drop("_year")
    live = split.where(F.col("_part") != "history")
    return {
        "current": split.where(F.col("_part") == "current").select(*names),
        "rejects": split.where(F.col("_part") == "rejects").select(*names),
        "history": not_among(dedup.latest_per_key(history, keys, [F.col("_arrival")]).select(*names), live, keys),
    }


def stored_watermark(spark: SparkSession, root: str, default: dt.date) -> dt.date:
    """The day of the oldest open ticket of the last complete run."""
    _, state = Published(spark, root).latest()
    return dt.date.fromisoformat(state["oldest_open"]) if state else default


def run_update(spark: SparkSession, root: str, tickets: DataFrame, as_of: dt.date, keys: list[str], order,
               date_col: str = "DATA") -> int:
    """C6 on storage: one night's rows into the tables below ``root``; returns
    the version.

    Everything a night changes is published at once, so a run that dies
    changes nothing and can be repeated.  The current part and the rejects
    are written anew (they reach back to the oldest open ticket only); the
    history grows by a folder with the rows that are new or differ from what
    it holds, partitioned by year, and is never rewritten.  A second run over
    the same rows adds no history and publishes the same tables.
    """
    store = Published(spark, root)
    version, state = store.latest()
    schema, names = tickets.schema, tickets.columns
    before = _split(spark, state.get("split"), schema)
    base = before.where(F.col("_part") != "history").select(*names)
    every = latest_arrival(tickets, base, keys, order).select(*names)
    folder = store.new_folder("split")
    part = F.when(F.col("destino") == "historico", "history").when(F.col("destino") == "atual", "current").otherwise("rejects")
    # the watermark is needed before the split: the rows are stored once, undivided, and read for both
    staged = store.new_folder("staged")
    every.write.parquet(staged)
    every = spark.read.schema(schema).parquet(staged)
    watermark = oldest_open(every, as_of, date_col)
    resplit(every, watermark, date_col).withColumn("_part", part).drop("destino").write.partitionBy("_part").parquet(folder)
    closed = _split(spark, folder, schema).where(F.col("_part") == "history").select(*names)
    closed = closed.withColumn("_year", F.year(date_col))
    held = _history(spark, state.get("history", []), schema)
    wanted = closed.select("_year", *keys).distinct()
    held = not_among(held, wanted, ["_year", *keys], "left_semi")  # the years of the new rows only (dynamic partition pruning)
    held = dedup.latest_per_key(held, [*keys, "_year"], [F.col("_arrival")]).select(*names, "_year")
    same = reduce(lambda a, b: a & b, [closed[c].eqNullSafe(held[c]) for c in [*names, "_year"]])
    fresh = closed.join(held, same, "left_anti").withColumn("_arrival", F.lit(version + 1).cast("long"))
    delta = store.new_folder("history")
    fresh.write.partitionBy("_year").parquet(delta)
    day = watermark.first()[0]
    grown = [*state.get("history", []), delta] if _has_rows(spark, delta, schema) else state.get("history", [])
    number = store.publish({"split": folder, "history": grown, "oldest_open": day.isoformat()}, version)
    store.clean()
    return number


def _has_rows(spark: SparkSession, folder: str, schema: T.StructType) -> bool:
    return not _history(spark, [folder], schema).isEmpty()
