"""Delimited-file sources and sinks.

Reads use an explicit schema (no inference pass over the data) and
PERMISSIVE mode.  A trailing ``_overflow`` column catches rows with too
many fields, which are then dropped, while short rows are kept with nulls
(``DROPMALFORMED`` would also drop the short rows).
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions import expr as E
from fieldlens.operators.dedup import latest_per_key
from fieldlens.operators.joins import last_value
from fieldlens.session import checkpoint_dir

OVERFLOW = "_overflow"


class MissingColumnsError(ValueError):
    """Raised when a frame lacks required columns."""


# S19 ---------------------------------------------------------------------
def require_columns(df: DataFrame | None, required: Iterable[str], name: str = "dados") -> DataFrame | None:
    """Raise if a non-empty schema lacks columns; ``None`` or a frame without
    columns passes (an empty input is allowed)."""
    if df is None or not df.columns:
        return df
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{name}: colunas ausentes: {', '.join(missing)}")
    return df


TICKET_COLUMNS = ["SS", "Tarefa", "Status", "Chassi"]
UNIT_COLUMNS = ["NUM_SERIAL", "GARANTIA"]
ERROR_COLUMNS = ["SS"]


# S5 ----------------------------------------------------------------------
def normalize_header(name: str, upper: bool = False) -> str:
    n = name.replace("﻿", "").strip()
    return n.upper() if upper else n


def repair_headers(df: DataFrame, upper: bool = False) -> DataFrame:
    return df.toDF(*[normalize_header(c, upper) for c in df.columns])


# S1-S3 -------------------------------------------------------------------
def string_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Column names from the header line (only the first line is read)."""
    first = (spark.read.option("encoding", encoding).option("sep", sep).option("header", False)
             .csv(path).limit(1).collect())
    return [c if c is not None else f"_c{i}" for i, c in enumerate(first[0])] if first else []


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ";",
                   encoding: str = "UTF-8", skip_long_rows: bool = True, upper_headers: bool = False) -> DataFrame:
    """Read a header-first delimited file with a declared schema.

    Columns are bound by their header name: fields are read as text in the
    order of the header, then the declared ones are picked and cast (a text
    that does not fit is null, a column that the file lacks too).  Without a
    schema every header column is read as text.  Rows with more fields than
    the header are skipped; rows with fewer are kept.
    """
    names = [normalize_header(c, upper_headers) for c in _header(spark, path, sep, encoding)]
    full = string_schema([*names, OVERFLOW])
    df = (spark.read.schema(full).option("sep", sep).option("header", True).option("enforceSchema", True)
          .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))
    if skip_long_rows:
        df = df.where(F.col(OVERFLOW).isNull())
    if schema is None:
        return df.drop(OVERFLOW)
    return _typed(df, schema)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (bytes as they are) with their file and place in it."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _utf8, _header) of each file, in one pass over the bytes:
    whether all its lines are valid UTF-8, and its first line."""
    return _lines(spark, path).groupBy("_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"), F.min_by("value", "_place").alias("_header"))


def read_any_encoding(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ";",
                      upper_headers: bool = False, order: str | None = None) -> DataFrame:
    """S1-S3, S5 over files of different encodings and headers.

    A file whose bytes are all valid UTF-8 is read as that, any other as
    Latin-1, which decodes every byte.  Each file has its own header; columns
    meet by name, and a column that a file lacks is null.  Rows with more
    fields than their header are skipped, shorter ones kept.  ``order`` adds
    the place of each row (file, place in it) under that name.  A quoted
    field cannot span lines.

    The bytes are read twice, to judge and to parse, whatever the encodings;
    what is kept in between is one row per file.
    """
    checkpoint_dir(spark)
    files = file_encodings(spark, path).checkpoint()
    heads = [(r["_header"], r["_utf8"]) for r in files.select(F.col("_header").cast("binary"), "_utf8").distinct().collect()]
    decoded = F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = _lines(spark, path).join(files, "_file").where(~F.col("value").eqNullSafe(F.col("_header")))
    lines = lines.withColumn("_line", decoded)
    parts = []
    for head, utf8 in heads:  # a few kinds of header, not one for each file
        if head is None:
            continue
        line = bytes(head).decode("utf-8" if utf8 else "latin-1")
        names = _apart([normalize_header(c, upper_headers) for c in next(csv.reader([line], delimiter=sep))])
        fields = string_schema([*[f"c{i}" for i in range(len(names))], OVERFLOW])
        row = F.from_csv("_line", fields.toDDL(), {"sep": sep, "mode": "PERMISSIVE"})
        part = lines.where((F.col("_header").cast("binary") == F.lit(bytes(head))) & (F.col("_utf8") == F.lit(utf8)))
        part = part.select(row.alias("r"), F.struct("_file", "_place").alias("_at")).where(F.col(f"r.{OVERFLOW}").isNull())
        at = [F.col("_at").alias(order)] if order else []
        parts.append(part.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], *at))
    if not parts:
        return spark.createDataFrame([], schema or T.StructType([]))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every if schema is None else _typed(every, schema)


read_with_fallback = read_any_encoding


def _apart(names: list[str]) -> list[str]:
    """Names that Spark can tell apart: the second of two that differ in case
    only, or not at all, gets the suffix _2, and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n.upper()] = seen.get(n.upper(), 0) + 1
        out.append(n if k == 1 else f"{n}_{k}")
    return out


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, cast from text; what does not fit is null."""
    have = {c.strip().upper(): c for c in reversed(df.columns)}
    picked = []
    for f in schema.fields:
        source = f.name if f.name in df.columns else have.get(f.name.strip().upper())
        col = F.col(f"`{source}`") if source is not None else F.lit(None).cast("string")
        picked.append((col if f.dataType == T.StringType() else E.strip(col).try_cast(f.dataType)).alias(f.name))
    return df.select(*picked)


# loaders -----------------------------------------------------------------
#: The columns that an export of units may bring.
UNIT_FILE_COLUMNS = ["Serial", "NUM_SERIAL", "RTM", "GARANTIA", "UF", "CIDADE", "ESTADO", "PAIS", "NOME_PAIS", "DT_NUM_NF", "ITEM",
                     "MODELO", "SÉRIE", "SERIE", "NUM_SERIE", "CLIENTE", "DURAÇÃO_GARANTIA", "DURACAO_GARANTIA"]


def load_ticket_files(spark: SparkSession, *paths: str, sep: str = ";") -> DataFrame:
    """C1 from files: the extracts on their common columns, trimmed, with the
    required columns checked, dates parsed, the latest row per ticket kept."""
    each = [E.trim_strings(require_columns(read_any_encoding(spark, p, sep=sep), TICKET_COLUMNS, p)) for p in paths]
    df = repair_headers(reduce(union_common, each), upper=True)
    plain = str.maketrans("ÁÇÍÉ", "ACIE")
    df = df.toDF(*[c.translate(plain) for c in df.columns])
    for c in ("DATA", "RESOLVIDO"):
        df = df.withColumn(c, E.parse_day_first(c) if c in df.columns else F.lit(None).cast("timestamp"))
    df = latest_per_key(df, ["SS", "TAREFA"], [F.col("DATA")])
    for c in ("PROPRIETARIO", "MANTENEDOR", "SERVICO", "TIPO", "SUMARIO", "RTM"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def load_unit_files(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """C2 from files: the allowed columns (S6) of an export of units, its
    serial under one name, texts trimmed and upper-cased, dates parsed."""
    df = select_allowed(read_any_encoding(spark, path, sep=sep), UNIT_FILE_COLUMNS)
    if "Serial" in df.columns:
        df = df.drop("NUM_SERIAL").withColumnRenamed("Serial", "NUM_SERIAL")
    df = E.trim_strings(require_columns(df, UNIT_COLUMNS, path), upper=True)
    return df.withColumn("DT_NUM_NF", (E.parse_day_first("DT_NUM_NF") if "DT_NUM_NF" in df.columns else F.lit(None)).cast("date"))


def load_error_files(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """S8 from files, with the required column checked."""
    return require_columns(clean_error_base(read_any_encoding(spark, path, sep=sep, upper_headers=True)), ERROR_COLUMNS, path)


def write_lookup(found: DataFrame, path: str, key: str = "ITEM") -> None:
    """Append looked-up rows with the time of the run; ``load_lookup``
    with ``order="LIDO_EM"`` takes the last one of each key."""
    found.where(F.col(key).isNotNull()).withColumn("LIDO_EM", F.current_timestamp()).write.mode("append").parquet(path)


# S6 ----------------------------------------------------------------------
def select_allowed(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Keep the allowed columns, matching names case- and space-insensitively;
    when none match, keep every column."""
    want = {a.strip().upper() for a in allowed}
    keep = [c for c in df.columns if c.strip().upper() in want]
    return df.select(*keep) if keep else df


# S7 / U1 -----------------------------------------------------------------
def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union on the columns both frames share (in the first frame's order)."""
    common = [c for c in a.columns if c in set(b.columns)]
    return a.select(*common).unionByName(b.select(*common))


def union_all_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union keeping every column (missing ones as null)."""
    return a.unionByName(b, allowMissingColumns=True)


# S8 ----------------------------------------------------------------------
def clean_error_base(df: DataFrame, money: Iterable[str] = ("VALOR_PECA", "VALOR_TOTAL")) -> DataFrame:
    """Full-row dedup, trimmed upper-case text, decimal-comma money -> number (null -> 0)."""
    money = [m for m in money if m in df.columns]
    out = E.trim_strings(df.dropDuplicates(), upper=True)
    for m in money:
        out = out.withColumn(m, E.decimal_comma_number(m))
    return out


# S9 ----------------------------------------------------------------------
def load_lookup(df: DataFrame, key: str = "ITEM", value: str = "GARANTIA", order: str | None = None) -> DataFrame:
    """Key -> value, skipping null keys/values; on duplicate keys the last row
    wins, by ``order`` if given, else in reading order (see ``in_file_order``)."""
    return last_value(df, key, value, order)


def in_file_order(df: DataFrame, name: str = "ORDEM") -> DataFrame:
    """Adds the place of each row of a file source: path, block and row within
    the block, so that 'the last row' is the same over several files."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select("*", place.alias(name))


def export_by_origin(frames: dict[str, DataFrame], path: str, fmt: str = "csv") -> str:
    """Tag each frame with its origin, union them and write one folder
    per origin (``origin=<name>``) plus the combined data in one dataset."""
    tagged = [df.withColumn("origin", F.lit(name)) for name, df in frames.items()]
    allrows = tagged[0]
    for d in tagged[1:]:
        allrows = allrows.unionByName(d, allowMissingColumns=True)
    w = allrows.write.mode("overwrite").partitionBy("origin")
    if fmt == "csv":
        w = w.option("header", True).option("sep", ";")
    w.format(fmt).save(path)
    return path
