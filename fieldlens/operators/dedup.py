"""Keep-one-row-per-key operators.

Implemented as a grouped ``max``/``min`` over a struct whose leading fields
are the sort keys, instead of ``row_number()`` over a window.  The
aggregate is combined map-side before the shuffle, so a key holding a
third of all rows is reduced to one row per task before it moves.  A struct
``max`` is a sort-based aggregate in Spark: each task sorts its own rows
before the combine, and what is left (one row per key and task) after the
shuffle; both sorts spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick_one(df: DataFrame, keys: list[str], order: list[Column | str], largest: bool,
              nulls_last: bool = True) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    lead, at = [], {}
    for i, o in enumerate(order):
        c, name = (F.col(o), o) if isinstance(o, str) else (o, None)
        if nulls_last and not largest:
            # a null sort key must lose; to max() it is the smallest value anyway
            lead.append(c.isNull().alias(f"_n{i}"))
        lead.append(c.alias(f"_o{i}"))
        if name is not None:
            at[name] = f"_o{i}"  # it comes back from its place in the order
    packed = F.struct(*lead, *[F.col(c) for c in payload if c not in at])
    agg = F.max(packed) if largest else F.min(packed)
    return df.groupBy(*keys).agg(agg.alias("_best")).select(*keys, *[F.col(f"_best.{at.get(c, c)}").alias(c) for c in payload])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (nulls lose).
    A column that ``order`` gives by its name is sorted and shuffled once, not a
    second time among the other columns."""
    return _pick_one(df, keys, order, largest=True)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the one with the smallest ``order`` (nulls last)."""
    return _pick_one(df, keys, order, largest=False)
