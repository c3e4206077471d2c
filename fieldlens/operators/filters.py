"""Row filters (P1-P19).  Each returns ``df.where(...)`` (or a semi join),
so Catalyst can push the predicates down to the scan where possible."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import dims
from fieldlens.functions import expr as E
from fieldlens.operators import kpi


# P1 ------------------------------------------------------------------------
def tags_exact(df: DataFrame, tags: Iterable[str], column: str = "TAGS") -> DataFrame:
    """Keep rows whose tag *set* equals ``tags`` exactly; empty selection = no filter."""
    want = sorted(set(tags))
    if not want:
        return df
    return df.where(F.array_sort(F.array_distinct(F.col(column))) == F.array(*[F.lit(t) for t in want]))


# P2 ------------------------------------------------------------------------
def in_lists(df: DataFrame, selections: Mapping[str, Iterable[str]]) -> DataFrame:
    """AND of IN-lists; an empty list or a missing column means no filter."""
    for col, values in selections.items():
        values = list(values or [])
        if values and col in df.columns:
            df = df.where(F.col(col).isin(values))
    return df


# P3 ------------------------------------------------------------------------
def by_status(df: DataFrame, status: str = "GERAL", column: str = "STATUS") -> DataFrame:
    """GERAL: all rows; ABERTO: open; FECHADO: everything not open (null included)."""
    if status == dims.STATUS_OPEN:
        return df.where(F.col(column) == dims.STATUS_OPEN)
    if status == dims.STATUS_CLOSED:
        return df.where(~F.col(column).eqNullSafe(dims.STATUS_OPEN))
    return df


# P4 ------------------------------------------------------------------------
def date_window(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                start_col: str = "INICIO", end_col: str = "FIM") -> DataFrame:
    """INICIO >= start and FIM <= end (midnight bounds; a null date fails)."""
    # bounds are built from text, so they mean the same instant whatever
    # the session time zone is
    if start is not None:
        df = df.where(F.col(start_col) >= F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(end_col) <= F.lit(f"{end.isoformat()} 00:00:00").cast("timestamp_ntz"))
    return df


# P5 ------------------------------------------------------------------------
def as_text(df: DataFrame, name: str) -> Column:
    """A column as the search sees it."""
    t = df.schema[name].dataType.simpleString()
    if t.startswith("array"):
        return F.array_join(F.col(name).cast("array<string>"), ", ")
    return F.col(name).cast("string")


def search_any_column(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive regex search over every column (as text); '' = no filter.

    Nulls never match; arrays are searched as their ', '-joined text.
    """
    if not term:
        return df
    cols = columns or df.columns
    pattern = "(?iu)" + term
    cond = None
    for c in cols:
        e = F.coalesce(as_text(df, c).rlike(pattern), F.lit(False))
        cond = e if cond is None else cond | e
    return df.where(cond)


# P6 ------------------------------------------------------------------------
def ticket_filter(df: DataFrame, tags: Iterable[str] = (), selections: Mapping[str, Iterable[str]] | None = None,
                  term: str = "", status: str = "GERAL", start: dt.date | None = None,
                  end: dt.date | None = None) -> DataFrame:
    """All ticket filters combined (order does not change the result)."""
    df = tags_exact(df, tags)
    df = in_lists(df, selections or {})
    df = by_status(df, status)
    df = date_window(df, start, end)
    return search_any_column(df, term)


# P7 ------------------------------------------------------------------------
def installed_base_filter(units: DataFrame, tickets: DataFrame, rtm: str = "TODOS", warranty: str = "TODOS",
                          startup: str = "TODOS", years: tuple[int, int] | None = None,
                          calls: tuple[int, int] | None = None) -> DataFrame:
    """Installed-base filter: RTM, warranty status, start-up class, invoice-year
    range and call-count range.  Serials without tickets count 0 calls."""
    flags = kpi.unit_ticket_flags(tickets)
    j = kpi._attach_flags(units, flags, per_serial=False)
    if rtm != "TODOS":
        j = j.where(F.col("RTM") == rtm)
    if warranty != "TODOS":
        j = j.where(F.col("STATUS_GARANTIA") == warranty)
    if startup == dims.STARTUP_OWN:
        j = j.where(F.col("has_startup"))
    elif startup == dims.STARTUP_THIRD_PARTY:
        j = j.where(~F.col("has_startup") & (F.col("n_valid_calls") > 0))
    elif startup == dims.STARTUP_NONE:
        j = j.where(~F.col("has_startup") & (F.col("n_valid_calls") == 0))
    if years is not None:
        j = j.where(F.col("ANO_NF").between(years[0], years[1]))
    if calls is not None:
        j = j.where(F.col("NUM_SERIAL").isNotNull() & F.col("n_calls").between(calls[0], calls[1]))
    return j.select(*units.columns)


# P8 ------------------------------------------------------------------------
ERROR_FILTER_COLUMNS = ["TIPO_ERRO", "DESC_ERRO", "COD_ERRO", "DETALHES_ERRO"]


def error_serial_filter(units: DataFrame, tickets: DataFrame, errors: DataFrame,
                        selections: Mapping[str, Iterable[str]]) -> DataFrame:
    """Keep units having a ticket whose SS is among the errors matching the
    selections; no selection at all = units unchanged."""
    if not any(list(v or []) for v in selections.values()):
        return units
    err = in_lists(errors, selections).select(E.strip("SS").alias("_ss")).distinct()
    serials = (tickets.join(err, E.strip(tickets.SS) == err._ss, "left_semi")
               .select(F.col("CHASSI").alias("_ser")).where(F.col("_ser").isNotNull()).distinct())
    return units.join(serials, units.NUM_SERIAL == serials._ser, "left_semi")


# P9 / P10 ------------------------------------------------------------------
def domestic_only(df: DataFrame) -> DataFrame:
    if "PAIS" in df.columns:
        return df.where(E.strip("PAIS") == "BR")
    if "NOME_PAIS" in df.columns:
        return df.where(F.upper(E.strip("NOME_PAIS")) == "BRASIL")
    return df


def drop_other_models(df: DataFrame) -> DataFrame:
    return df.where(F.col("MODELO") != dims.OTHER_MODEL)


# P11 -----------------------------------------------------------------------
def from_year(df: DataFrame, year: int, column: str = "ANO_NF") -> DataFrame:
    return df.where(F.col(column) >= year)


# P13 -----------------------------------------------------------------------
def product_predicate(variant: str) -> Column:
    """Product filters of the sales reports."""
    seg = F.coalesce(F.upper("SEGMENTO").contains("DISPENSER"), F.lit(False))
    w7 = F.coalesce(F.upper("ITEM").startswith("W7"), F.lit(False))
    bomba = F.coalesce(F.upper("DESCRICAO").contains("BOMBA"), F.lit(False))
    medidora = F.coalesce(F.upper("DESCRICAO").contains("BOMBA MEDIDORA"), F.lit(False))
    tipo = F.coalesce(F.upper("TIPO").isin(*dims.EQUIPMENT_TYPES), F.lit(False))
    return {
        "dispenser_w7": seg & w7,
        "w7": w7,
        "bomba": bomba,
        "bomba_medidora": medidora,
        "segment": seg,
        "w7_bomba": w7 & bomba,
        "w7_bomba_medidora": w7 & medidora,
        "tipo": tipo,
        "tipo_bomba_medidora": tipo & medidora,
        "linha_1_2": F.col("LINHA").isin("1", "2"),
        "all": F.lit(True),
    }[variant]


# P16 -----------------------------------------------------------------------
def trailing_months(df: DataFrame, months: int | None, column: str = "DATA_BASE") -> DataFrame:
    """Rows within ``months`` of the latest date in the data (None = all)."""
    if not months:
        return df
    mx = df.agg(F.max(column).alias("_max"))
    limit = F.col("_max") - F.make_ym_interval(F.lit(0), F.lit(months))
    # one-row frame: broadcasting it is bounded by construction
    return df.crossJoin(F.broadcast(mx)).where(F.col(column) >= limit).drop("_max")


# P17 -----------------------------------------------------------------------
def exclude_service_items(df: DataFrame, column: str = "DESCRICAO") -> DataFrame:
    return df.where(~F.coalesce(F.col(column).rlike("(?i)SERVICO|MANUTENCAO"), F.lit(False)))
