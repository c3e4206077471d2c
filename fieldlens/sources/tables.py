"""Lazy access to the parquet tables of one data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


_REGISTRY: dict[tuple[int, str], "Tables"] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> "Tables":
    """One ``Tables`` per (session, folder), so the lazy reads and derived
    view plans are built once per session (no data is cached)."""
    key = (id(spark), sf_dir)
    t = _REGISTRY.get(key)
    if t is None or t.spark is not spark:
        t = _REGISTRY[key] = Tables(spark, sf_dir)
    return t


class Tables:
    """``t.orders`` -> DataFrame over ``<sf_dir>/orders.parquet`` (read once per instance).

    Reads are lazy; Catalyst prunes the columns each plan needs and pushes
    filters into the parquet scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def memo(self, name: str, build) -> DataFrame:
        """Build a derived (lazy) view once and reuse the plan object."""
        if name not in self._views:
            self._views[name] = build()
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]
