"""Sales-line reports (C7 and the A17-A27 family).

All report variants are parameters of a few functions: the product filter
(P13 ``variant``), the warranty-text mode (F19 ``mode``), the years and the
reference date.  Lookups are left joins on ITEM; totals use GROUPING SETS
so per-year rows and totals come from one aggregation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import dims
from fieldlens.functions import expr as E
from fieldlens.operators.filters import exclude_service_items, product_predicate
from fieldlens.operators.joins import last_value
from fieldlens.operators.kpi import pct


def sales_silver(lines: DataFrame) -> DataFrame:
    """Typed sales lines: QTD (F5), DT (F4 as date) and ANO."""
    return (lines.withColumn("QTD", E.decimal_comma_number("QUANTIDADE"))
            .withColumn("DT", E.parse_day_first("DT_NUM_NF").cast("date"))
            .withColumn("ANO", F.year("DT")))


def warranty_days_by_item(item_warranty: DataFrame, mode: str) -> DataFrame:
    """ITEM -> warranty days of its last cached text under F19 ``mode`` (unknown -> 0)."""
    return last_value(item_warranty, "ITEM", "GARANTIA", _order(item_warranty)).select(
        "ITEM", F.coalesce(E.warranty_text_to_days("GARANTIA", mode), F.lit(0)).alias("W_DAYS"))


def rtm_by_item(item_rtm: DataFrame) -> DataFrame:
    """ITEM -> is_rtm ('SIM' contained in the value cached last)."""
    return last_value(item_rtm, "ITEM", "RTM", _order(item_rtm)).select(
        "ITEM", F.upper("RTM").contains("SIM").alias("IS_RTM"))


def _order(cache: DataFrame) -> str | None:
    """The column that tells which cached row is the later one, if the cache has it."""
    return "ORDEM" if "ORDEM" in cache.columns else None


def _item_values(item_warranty: DataFrame, item_rtm: DataFrame, mode: str) -> DataFrame:
    """One item dimension of both caches: ITEM, W_DAYS, IS_RTM."""
    return warranty_days_by_item(item_warranty, mode).join(rtm_by_item(item_rtm), "ITEM", "full")


def _category(is_rtm: Column) -> Column:
    return F.when(F.coalesce(is_rtm, F.lit(False)), "RTM").otherwise("NON_RTM")


def warranty_sales_by_year(lines: DataFrame, item_warranty: DataFrame, item_rtm: DataFrame, as_of: dt.date,
                           variant: str = "dispenser_w7", mode: str = "numeric",
                           years: list[int] | None = None) -> DataFrame:
    """Quantity sold, quantity still under normal and electronic
    warranty, per (year, RTM category) plus a 'Total' per category.

    Lines are summed per (item, day) before the one join with the item
    dimension, so an item that holds a third of all lines joins few rows.
    """
    s = sales_silver(lines).where(product_predicate(variant) & F.col("DT").isNotNull())
    if years:
        s = s.where(F.col("ANO").isin(years))
    s = s.groupBy("ITEM", "ANO", "DT").agg(F.sum("QTD").alias("QTD"))
    j = s.join(_item_values(item_warranty, item_rtm, mode), "ITEM", "left")
    j = j.select(F.col("ANO"), _category(F.col("IS_RTM")).alias("categoria"), "QTD",
                 (F.date_add("DT", F.coalesce(F.col("W_DAYS"), F.lit(0))) >= E.as_of_lit(as_of)).alias("norm"),
                 E.electronic_warranty_active("DT", as_of).alias("elec"))
    g = j.groupingSets([["ANO", "categoria"], ["categoria"]], "ANO", "categoria").agg(
        F.sum("QTD").alias("sales"),
        F.sum(F.when(F.col("norm"), F.col("QTD")).otherwise(0.0)).alias("norm_qty"),
        F.sum(F.when(F.col("elec"), F.col("QTD")).otherwise(0.0)).alias("elec_qty"),
        F.grouping("ANO").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("ANO").cast("string")).alias("ano"),
                    "categoria", "sales", "norm_qty", "elec_qty",
                    pct(F.col("norm_qty"), F.col("sales")).alias("pct_norm"),
                    pct(F.col("elec_qty"), F.col("sales")).alias("pct_elec"))


def units_inline_fill(lines: DataFrame, item_warranty: DataFrame, item_rtm: DataFrame, as_of: dt.date) -> DataFrame:
    """Inline warranty and RTM values win unless blank or
    'NAO ENCONTRADO'; otherwise the value cached last; otherwise 0 days / 'NAO'.
    Counted by RTM class.

    Lines are summed per (item, inline values, day) before the one join with
    the item dimension; the cached texts are parsed once per item and the
    inline texts once per group.
    """
    s = (sales_silver(lines).groupBy("ITEM", "GARANTIA", "RTM", "DT")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("QTD").alias("QTD")))
    iw = last_value(item_warranty, "ITEM", "GARANTIA", _order(item_warranty))
    iw = iw.select("ITEM", F.coalesce(E.warranty_text_to_days(E.blank_aware_coalesce(F.lit(None).cast("string"), "GARANTIA", "0")),
                                      F.lit(0)).alias("_lookup_days"))
    ir = last_value(item_rtm, "ITEM", "RTM", _order(item_rtm)).withColumnRenamed("RTM", "_rt")
    j = s.join(iw.join(ir, "ITEM", "full"), "ITEM", "left")
    inline = F.col("GARANTIA")
    inline_ok = ~(inline.isNull() | (E.strip(inline) == "") | (E.strip(inline) == dims.NOT_FOUND))
    days = F.when(inline_ok, F.coalesce(E.warranty_text_to_days(inline), F.lit(0))).otherwise(
        F.coalesce(F.col("_lookup_days"), F.lit(0)))
    rtm = E.blank_aware_coalesce("RTM", "_rt", "NAO")
    j = j.select((rtm == "SIM").alias("is_rtm"), "QTD", "n",
                 F.coalesce(F.date_add("DT", days) >= E.as_of_lit(as_of), F.lit(False)).alias("norm"),
                 E.electronic_warranty_active("DT", as_of).alias("elec"))
    return j.groupBy("is_rtm").agg(F.sum("n").alias("linhas"), F.sum("QTD").alias("quantidade"),
                                   F.sum(F.when(F.col("norm"), F.col("n")).otherwise(0)).alias("garantia_ativa"),
                                   F.sum(F.when(F.col("elec"), F.col("n")).otherwise(0)).alias("garantia_eletronica_ativa"))


KEYWORD_FILTERS = ["bomba", "bomba_medidora", "segment", "w7", "linha_1_2", "w7_bomba", "w7_bomba_medidora", "tipo",
                   "tipo_bomba_medidora"]


def keyword_quantities(lines: DataFrame) -> DataFrame:
    """Total quantity under each product filter, in one pass, as rows."""
    s = sales_silver(lines)
    wide = s.agg(*[F.sum(F.when(product_predicate(k), F.col("QTD")).otherwise(0.0)).alias(k) for k in KEYWORD_FILTERS])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("filtro"), F.col(k).alias("quantidade"))
                                           for k in KEYWORD_FILTERS])).alias("r")).select("r.*")


DATE_KINDS = ["DT_NUM_NF", "DATA_CRIACAO", "DATA_BOOKED"]


def quantity_by_date_kind(lines: DataFrame) -> DataFrame:
    """Quantity per year under each of three alternative dates."""
    s = lines.withColumn("QTD", E.decimal_comma_number("QUANTIDADE"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("tipo_data"), F.col(k).alias("_txt")) for k in DATE_KINDS]))
    x = s.select("QTD", kinds.alias("k")).select("QTD", "k.tipo_data",
                                                  F.year(E.parse_day_first("k._txt")).alias("ano"))
    return x.where(F.col("ano").isNotNull()).groupBy("tipo_data", "ano").agg(F.sum("QTD").alias("quantidade"))


def quantity_by(lines: DataFrame, key: str, variant: str = "all") -> DataFrame:
    """Quantity per ``key`` value under a product filter, largest first."""
    s = sales_silver(lines).where(product_predicate(variant))
    return (s.groupBy(F.col(key).alias("chave")).agg(F.sum("QTD").alias("quantidade"))
            .orderBy(F.desc("quantidade"), "chave"))


def rtm_split(lines: DataFrame, item_rtm: DataFrame, variant: str = "bomba_medidora") -> DataFrame:
    """RTM / non-RTM / total quantity under a product filter (missing lookup -> non-RTM)."""
    s = sales_silver(lines).where(product_predicate(variant)).groupBy("ITEM").agg(F.sum("QTD").alias("QTD"))
    s = s.join(rtm_by_item(item_rtm), "ITEM", "left")
    g = s.select(_category(F.col("IS_RTM")).alias("categoria"), "QTD").groupingSets(
        [["categoria"], []], "categoria").agg(F.sum("QTD").alias("quantidade"), F.grouping("categoria").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("categoria")).alias("categoria"),
                    "quantidade")


def top_items(lines: DataFrame, variant: str = "w7", n: int = 20) -> DataFrame:
    """The ``n`` (LINHA, ITEM, DESCRICAO) groups with the largest
    quantity, each with the quantity of all groups (``total``)."""
    s = sales_silver(lines).where(product_predicate(variant))
    g = s.groupBy("LINHA", "ITEM", "DESCRICAO").agg(F.sum("QTD").alias("quantidade"))
    total = F.broadcast(s.agg(F.sum("QTD").alias("total")))  # one row
    return g.orderBy(F.desc("quantidade"), "LINHA", "ITEM", "DESCRICAO").limit(n).crossJoin(total)


def rtm_items_ranked(lines: DataFrame, item_rtm: DataFrame, top: int | None = None) -> DataFrame:
    """Quantity per RTM item (lookup says SIM), largest first."""
    s = sales_silver(lines).groupBy("ITEM").agg(F.sum("QTD").alias("quantidade"))
    s = s.join(rtm_by_item(item_rtm).where("IS_RTM"), "ITEM", "left_semi").orderBy(F.desc("quantidade"), "ITEM")
    return s.limit(top) if top else s


def filter_gap_audit(lines: DataFrame, item_rtm: DataFrame, n: int = 20) -> DataFrame:
    """RTM items that the 'W7 + BOMBA MEDIDORA' filter drops, with the
    number of lines that pass each rule and the segment rule; the ``n``
    largest by quantity."""
    seg, w7, med = product_predicate("segment"), product_predicate("w7"), product_predicate("bomba_medidora")
    s = sales_silver(lines).where(~(w7 & med)).groupBy("ITEM", "DESCRICAO").agg(
        F.sum("QTD").alias("quantidade"), F.sum(seg.cast("int")).alias("passa_segmento"),
        F.sum(w7.cast("int")).alias("passa_item"), F.sum(med.cast("int")).alias("passa_descricao"))
    return (s.join(rtm_by_item(item_rtm).where("IS_RTM"), "ITEM", "left_semi")
            .orderBy(F.desc("quantidade"), "ITEM", "DESCRICAO").limit(n))


def lookup_miss_report(lines: DataFrame, item_rtm: DataFrame, variant: str = "dispenser_w7", year: int | None = None,
                       n: int = 20) -> DataFrame:
    """Non-RTM quantity per (item, description) of a product filter and
    year with its lookup status (every one that does not contain SIM); a
    missing lookup is reported as 'NAO (Cache Miss)'."""
    ir = last_value(item_rtm, "ITEM", "RTM", _order(item_rtm)).withColumnRenamed("RTM", "_rt")
    s = sales_silver(lines).where(product_predicate(variant))
    if year:
        s = s.where(F.col("ANO") == year)
    s = s.groupBy("ITEM", "DESCRICAO").agg(F.sum("QTD").alias("quantidade")).join(ir, "ITEM", "left")
    status = F.coalesce(F.upper(E.strip("_rt")), F.lit("NAO (Cache Miss)"))
    return (s.select("ITEM", "DESCRICAO", status.alias("status_rtm"), "quantidade").where(~F.col("status_rtm").contains("SIM"))
            .orderBy(F.desc("quantidade"), "ITEM", "DESCRICAO").limit(n))


def service_excluded_total(lines: DataFrame, variant: str = "w7") -> DataFrame:
    """Lines and quantity under a filter once service items are removed."""
    s = exclude_service_items(sales_silver(lines).where(product_predicate(variant)))
    return s.agg(F.count(F.lit(1)).alias("linhas"), F.coalesce(F.sum("QTD"), F.lit(0.0)).alias("quantidade"))


def lines_per_year(lines: DataFrame) -> DataFrame:
    """Distinct LINHA values per invoice year."""
    return sales_silver(lines).where(F.col("ANO").isNotNull()).select("ANO", "LINHA").distinct()


def sample_lines(lines: DataFrame, item_rtm: DataFrame, year: int, n: int = 5) -> DataFrame:
    """The first ``n`` lines of a year in the order of their columns, each with the lookup status of its item
    (a missing one is NAO); the lines are picked before the join."""
    keys = [F.asc_nulls_last(c) for c in ("LINHA", "ITEM", "DESCRICAO", "QTD")]
    picked = (sales_silver(lines).where(F.col("ANO") == year).select("LINHA", "ITEM", "DESCRICAO", "QTD")
              .orderBy(*keys).limit(n))
    ir = last_value(item_rtm, "ITEM", "RTM", _order(item_rtm)).withColumnRenamed("RTM", "_rt")
    return picked.join(ir, "ITEM", "left").select(
        "LINHA", "ITEM", "DESCRICAO", F.col("QTD").alias("quantidade"),
        F.coalesce(F.upper(E.strip("_rt")), F.lit("NAO")).alias("status_rtm"))


def rows_per_year(lines: DataFrame) -> DataFrame:
    """Rows per invoice year (unparseable dates in a NULL year)."""
    return sales_silver(lines).groupBy("ANO").agg(F.count(F.lit(1)).alias("linhas"))


def date_range(lines: DataFrame) -> DataFrame:
    """First and last parseable date of each date column."""
    return lines.agg(*[f(E.parse_day_first(c).cast("date")).alias(f"{n}_{c.lower()}")
                       for c in DATE_KINDS for f, n in ((F.min, "min"), (F.max, "max"))])


def lines_from_year(lines: DataFrame, year: int) -> DataFrame:
    """Lines whose invoice date holds a year from ``year`` on.  The year is
    the first run of four digits, whatever the rest of the text looks like."""
    return lines.withColumn("ANO", E.year_from_text("DT_NUM_NF")).where(F.col("ANO") >= year)


def items_to_look_up(lines: DataFrame, cached: DataFrame, year: int) -> DataFrame:
    """P18 + J6: distinct items of lines from ``year`` on with a blank warranty,
    minus the items already cached."""
    need = lines_from_year(lines, year).where(F.col("GARANTIA").isNull() | (E.strip("GARANTIA") == ""))
    items = need.select("ITEM").where(F.col("ITEM").isNotNull()).distinct()
    return items.join(cached.select("ITEM"), "ITEM", "left_anti")


def enrichment_report(lines: DataFrame, cached: DataFrame, year: int) -> DataFrame:
    """Rows to check, unique items, already cached, to fetch, % of fetches saved."""
    need = lines_from_year(lines, year).where(F.col("GARANTIA").isNull() | (E.strip("GARANTIA") == ""))
    items = need.select("ITEM").where(F.col("ITEM").isNotNull()).groupBy("ITEM").agg(F.count(F.lit(1)).alias("_n"))
    c = cached.select("ITEM").distinct().withColumn("_hit", F.lit(True))
    j = items.join(c, "ITEM", "left")
    r = j.agg(F.sum("_n").alias("linhas_a_verificar"), F.count(F.lit(1)).alias("itens_unicos"),
              F.count_if(F.coalesce("_hit", F.lit(False))).alias("em_cache"))
    return r.select(F.coalesce("linhas_a_verificar", F.lit(0)).cast("long").alias("linhas_a_verificar"),
                    "itens_unicos", "em_cache", (F.col("itens_unicos") - F.col("em_cache")).alias("a_buscar"),
                    pct(F.col("em_cache"), F.col("itens_unicos")).alias("pct_economia"))
