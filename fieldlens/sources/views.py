"""Field-service tables derived from the driver tables.

The driver data has no service tickets or equipment, so these views give
every column the operators need a deterministic definition over the TPC-H
style tables (see README for the mapping).  Each view is a plain DataFrame
plan; the DuckDB oracle in ``fieldlens.plans.oracle`` defines the same views
in SQL so results can be compared value by value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.sources.tables import Tables

# Fixed reference date of every driver query.
AS_OF = dt.date(1999, 1, 1)

# Item prefixes assigned to customers (installed base) and parts (sales).
# 'ZZ9' and 'W7X' are not in the model mapping, so they become OUTROS.
UNIT_PREFIXES = ["W7HX2", "W7GVIS", "W7GCEN", "3G2209P", "W7E123", "7502A", "ZZ9"]
SALES_PREFIXES = ["W7HX2", "W7GVIS", "W7GCEN", "3G2209P", "W7E123", "7502A", "ZZ9", "W7X"]


def _pick(values: list[str], idx: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def _dmy(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


# ---------------------------------------------------------------- tickets
def ticket_extract(t: Tables) -> DataFrame:
    """Ticket rows at lineitem grain, raw columns only.

    Several rows may share a ticket key (l_orderkey, l_linenumber), which
    becomes (SS, TAREFA): the feed is the union of the open and closed
    extracts, so W1 must keep the latest one.  The dedup runs on these raw
    (numeric and one-character) columns; the text columns are derived after
    it, so less data is sorted and shuffled.
    """
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                             "l_shipdate", "l_quantity", "l_linestatus", "l_returnflag")


def derive_ticket_columns(extract: DataFrame, *more: str) -> DataFrame:
    """Raw lineitem columns -> ticket columns (dates, status, type, RTM text); ``more`` columns stay."""
    return extract.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_shipdate").alias("DATA"),
        F.when(F.col("l_linestatus") == "F",
               F.timestamp_add("DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate"))).alias("RESOLVIDO"),
        F.when(F.col("l_linestatus") == "O", "ABERTO").otherwise("FECHADO").alias("STATUS"),
        F.when(F.col("l_returnflag") == "A", "WBP EQUIPAMENTO DOMESTICO")
        .when(F.col("l_returnflag") == "R", "Wbp Equipamento Exportacao").otherwise(F.col("l_returnflag")).alias("TIPO"),
        F.when(F.col("l_partkey") % 3 == 0, "Com RTM").when(F.col("l_partkey") % 3 == 1, "rtm-bt")
        .otherwise("MECANICA").alias("RTM_RAW"), *more,
    )


def ticket_feed(t: Tables) -> DataFrame:
    """Ticket rows with derived columns, duplicates included."""
    return derive_ticket_columns(ticket_extract(t))


#: What the joins with orders, suppliers and parts attach.
TICKET_ATTRIBUTES = ["o_custkey", "o_orderpriority", "o_orderstatus", "s_name", "p_name", "p_brand", "p_type", "p_size"]


def join_ticket_attributes(feed: DataFrame, orders: DataFrame, suppliers: DataFrame, t: Tables) -> DataFrame:
    """Attach order, supplier and part attributes (all many-to-one joins)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (feed.join(o, feed.l_orderkey == o.o_orderkey)
            .join(suppliers, feed.l_suppkey == suppliers.s_suppkey)
            .join(p, feed.l_partkey == p.p_partkey))


def enrich_ticket_feed(feed: DataFrame, t: Tables) -> DataFrame:
    """Attach order, supplier and part attributes and make the texts of a ticket."""
    return ticket_texts(join_ticket_attributes(feed, t.orders, t.supplier.select("s_suppkey", "s_name"), t))


def ticket_texts(j: DataFrame, *more: str) -> DataFrame:
    """The raw columns of a ticket from those of the feed and its attributes; ``more`` columns stay."""
    cust = F.col("o_custkey").cast("string")
    bracketed = F.concat(F.when(F.col("p_size") % 10 == 0, F.lit("[stb] ")).otherwise(F.lit("")),
                         F.lit("["), F.col("p_type"), F.lit("] ["), F.lower("p_brand"), F.lit("] "), F.col("p_name"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("SS"),
        F.col("l_linenumber").cast("string").alias("TAREFA"),
        F.when(F.col("o_custkey") % 4 == 0, F.concat(cust, F.lit(".0"))).otherwise(cust).alias("CHASSI"),
        "DATA", "RESOLVIDO", "STATUS",
        F.col("o_orderstatus").alias("PROPRIETARIO"),
        F.col("s_name").alias("MANTENEDOR"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "PARTIDA INICIAL").otherwise(F.col("o_orderpriority")).alias("SERVICO"),
        "TIPO",
        F.when(F.col("p_size") % 10 == 5, F.col("p_name")).otherwise(bracketed).alias("SUMARIO"),
        F.col("RTM_RAW").alias("RTM"),
        "l_partkey", "l_suppkey", "l_extendedprice", *more,
    )


def raw_tickets(t: Tables) -> DataFrame:
    """The merged raw ticket extract (duplicates included)."""
    return enrich_ticket_feed(ticket_feed(t), t)


TICKET_KEYS = ["l_orderkey", "l_linenumber"]


def ticket_order() -> list[str]:
    """W1 order on the raw extract: latest ship date (DATA) wins, ties broken
    by the greatest (part, supplier, price)."""
    return ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


# --------------------------------------------------------------- lookups
def maintainer_dim(t: Tables) -> DataFrame:
    """Raw maintainer name -> display name (about 10% of suppliers unmapped)."""
    s = t.supplier
    return s.where(s.s_suppkey % 10 != 9).select(
        F.col("s_name").alias("raw"),
        F.concat(F.lit("SAW-"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("label"))


def specialist_dim(t: Tables) -> DataFrame:
    """Raw maintainer name -> specialist (about 10% unmapped)."""
    s = t.supplier
    return s.where(s.s_suppkey % 10 != 8).select(
        F.col("s_name").alias("raw"),
        F.concat(F.lit("ESP-"), (F.col("s_suppkey") % 7).cast("string")).alias("label"))


def owner_dim(spark) -> DataFrame:
    """Raw owner code -> owner name (fixed, 2 rows; 'P' stays unmapped)."""
    return spark.sql("SELECT * FROM VALUES ('O', 'OWNER OPEN'), ('F', 'OWNER FINAL') AS t(raw, label)")


# -------------------------------------------------------- installed base
def raw_installed_base(t: Tables) -> DataFrame:
    """One row per (order, unit): the unpacked shipment lines."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    country = F.when(F.col("r_name") == "AMERICA", "BR").otherwise(F.upper(F.substring("r_name", 1, 2)))
    days = (F.when(F.col("o_orderkey") % 6 == 0, "183").when(F.col("o_orderkey") % 6 == 1, "365")
            .when(F.col("o_orderkey") % 6 == 2, "548").when(F.col("o_orderkey") % 6 == 3, "730")
            .when(F.col("o_orderkey") % 6 == 4, "1095").otherwise(""))
    state_code = F.concat(F.chr(F.col("n_nationkey") + 65), F.chr(F.col("n_regionkey") + 65))
    return j.select(
        F.col("o_custkey").cast("string").alias("NUM_SERIAL"),
        F.concat(_pick(UNIT_PREFIXES, F.col("c_custkey") % 7), F.lit("-"), F.col("o_orderkey").cast("string")).alias("ITEM"),
        F.col("o_orderdate").cast("date").alias("DT_NUM_NF"),
        days.alias("GARANTIA"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "SIM").otherwise("NAO").alias("RTM"),
        F.col("n_name").alias("UF"),
        country.alias("PAIS"),
        F.col("c_name").alias("CLIENTE"),
        F.col("c_mktsegment").alias("SEGMENTO"),
        F.concat(F.lit("Rua "), F.col("c_custkey").cast("string"), F.lit(", Cidade, "), state_code,
                 F.lit(", "), country).alias("ENDERECO"),
        F.col("o_orderkey").alias("ORDER_KEY"),
    )


# ---------------------------------------------------------------- errors
def raw_errors(t: Tables) -> DataFrame:
    """Remote-monitoring error base: the error events, linked to tickets by SS."""
    e = t.events
    return e.where(e.event_type == "error").select(
        F.col("event_id").cast("string").alias("SS"),
        F.concat(F.lit("TIPO "), (F.col("user_id") % 5).cast("string")).alias("TIPO_ERRO"),
        F.col("props").alias("DESC_ERRO"),
        F.concat(F.lit("E"), F.lpad((F.col("user_id") % 17).cast("string"), 3, "0")).alias("COD_ERRO"),
        F.when(F.col("value") >= 250, "ALTO").otherwise("BAIXO").alias("DETALHES_ERRO"),
        (F.col("value") / 4).alias("VALOR_PECA"),
        F.col("value").alias("VALOR_TOTAL"),
    )


# ----------------------------------------------------------- sales lines
def item_code(partkey: Column) -> Column:
    return F.concat(_pick(SALES_PREFIXES, partkey % 8), F.lit("-"), partkey.cast("string"))


def raw_sales_lines(t: Tables) -> DataFrame:
    """Order lines as exported: everything text, day-first dates, decimal commas."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    o = t.orders.select("o_orderkey", "o_orderdate")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    ln = F.col("l_linenumber")
    qty = F.col("l_quantity").cast("int").cast("string")
    desc = (F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("BOMBA MEDIDORA DE COMBUSTIVEIS LIQUIDOS - "),
                                                      F.upper("p_brand"), F.lit(" - "), F.upper("p_name")))
            .when(F.col("p_size") % 4 == 1, F.concat(F.lit("BOMBA "), F.upper("p_name")))
            .when(F.col("p_size") % 4 == 2, F.concat(F.lit("SERVICO DE MANUTENCAO "), F.upper("p_name")))
            .otherwise(F.upper("p_name")))
    seg = (F.when(F.col("p_size") <= 20, "DISPENSERS").when(F.col("p_size") <= 35, "PECAS").otherwise("SERVICOS"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("PEDIDO"),
        ln.cast("string").alias("LINHA"),
        item_code(F.col("l_partkey")).alias("ITEM"),
        desc.alias("DESCRICAO"),
        seg.alias("SEGMENTO"),
        F.when(F.col("l_returnflag") == "A", "WBP EQUIPAMENTO DOMESTICO")
        .when(F.col("l_returnflag") == "R", "Wbp Equipamento Exportacao").otherwise(F.col("l_returnflag")).alias("TIPO"),
        F.when(ln % 2 == 0, F.concat(qty, F.lit(",0"))).otherwise(qty).alias("QUANTIDADE"),
        F.when(ln == 7, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(_dmy(F.col("l_shipdate"))).alias("DT_NUM_NF"),
        _dmy(F.col("o_orderdate")).alias("DATA_CRIACAO"),
        _dmy(F.timestamp_add("DAY", F.lit(3), F.col("o_orderdate"))).alias("DATA_BOOKED"),
        F.when(ln % 3 == 0, "").when(ln % 3 == 1, "NAO ENCONTRADO")
        .otherwise(((F.col("l_orderkey") % 3 + 1) * 365).cast("string")).alias("GARANTIA"),
        F.when(ln % 4 == 0, "SIM").when(ln % 4 == 1, "NAO").otherwise("").alias("RTM"),
    )


def item_warranty(t: Tables) -> DataFrame:
    """Cached item -> warranty text (about 10% of items missing)."""
    p = t.part
    k = F.col("p_size") % 8
    text = (F.when(k == 0, "GARANTIA: 36 MESES").when(k == 1, "12 MONTHS").when(k == 2, "730")
            .when(k == 3, F.lit(None).cast("string")).when(k == 4, "2 ANOS").when(k == 5, "NAO ENCONTRADO")
            .when(k == 6, "Warranty - 18 meses").otherwise("30 MESES"))
    return p.where(p.p_partkey % 10 != 0).select(item_code(F.col("p_partkey")).alias("ITEM"), text.alias("GARANTIA"))


def item_rtm(t: Tables) -> DataFrame:
    """Cached item -> RTM flag (about 10% of items missing)."""
    p = t.part
    return p.where(p.p_partkey % 10 != 1).select(
        item_code(F.col("p_partkey")).alias("ITEM"),
        F.when(F.col("p_partkey") % 3 == 0, "SIM").otherwise("NAO").alias("RTM"))


# ---------------------------------------------------------- fetched pages
def serial_pages(t: Tables) -> DataFrame:
    """Shipment page per order line: a decoy table, then a border=1 table
    listing 0-2 serials (no serial table at all on every fifth line)."""
    li = t.lineitem.select("l_orderkey", "l_linenumber")
    n = F.col("l_linenumber") % 3
    idx = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = F.transform(idx, lambda i: F.concat(F.lit("<tr><td> "), (F.col("l_orderkey") * 10 + i).cast("string"),
                                               F.lit(" </td><td>ok</td></tr>")))
    table = F.concat(F.lit('<table><tr><td>x</td></tr><tr><td>decoy</td></tr></table>'
                           '<table border="1"><tr><th>Serial</th><th>Obs</th></tr>'),
                     F.array_join(rows, ""), F.lit("</table>"))
    html = F.when(F.col("l_linenumber") % 5 == 4, F.lit("<p>sem tabela</p>")).otherwise(table)
    return li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
                     .alias("page_key"), html.alias("html"))


def item_pages(t: Tables) -> DataFrame:
    """Product page per item (warranty cell and connectivity text), plus the
    crawled pages of the ``pages`` table."""
    p = t.part
    k = F.col("p_size") % 5
    cell = (F.when(k == 0, "Garantia: <b>36 MESES</b>").when(k == 1, "WARRANTY 12 months")
            .when(k == 2, "Prazo: 24 meses").when(k == 3, "  garantia de 2 anos").otherwise(""))
    r = F.col("p_partkey") % 4
    rtm = F.when(r == 0, "Conectividade BLUETOOTH").when(r == 1, "modulo bluetooh").otherwise("mecanica")
    html = F.concat(F.lit("<html><body><table><tr><td>Descrição</td><td>"), F.col("p_name"),
                    F.lit("</td></tr><tr><td>"), cell, F.lit("</td></tr></table><p>"), rtm, F.lit("</p></body></html>"))
    items = p.select(item_code(F.col("p_partkey")).alias("page_key"), html.alias("html"))
    crawled = t.pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("page_key"), "html")
    return items.unionByName(crawled)


def nested_serial_pages(t: Tables) -> DataFrame:
    """Shipment page per order that a regex cannot read: by order key a table
    inside a cell, a very long row, or references and a commented-out table."""
    key = F.col("o_orderkey")
    k = key.cast("string")
    head = F.lit('<table><tr><td>x</td></tr></table><table border="1"><tr><th>Serial</th></tr>')
    inner = F.concat(F.lit("<tr><td>"), k, F.lit("<table><tr><td>"), k, F.lit("a</td></tr></table></td></tr><tr><td>"), k, F.lit("b</td></tr></table>"))
    long = F.concat(F.lit("<tr><td>"), k, F.lit("</td><td>"), F.repeat(F.lit("obs "), 600), F.lit("</td></tr></table>"))
    refs = F.concat(F.lit("<!-- <table><tr><td>old</td></tr> --><tr><td>&nbsp;S&#45;"), k, F.lit("<table></table>&#x41;</td></tr></table>"))
    html = F.concat(head, F.when(key % 3 == 0, inner).when(key % 3 == 1, long).otherwise(refs))
    return t.orders.select(k.alias("page_key"), html.alias("html"))


def report_pages(t: Tables) -> DataFrame:
    """Report page per order: a header, a row per ticket and a totals row."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("l_linenumber").cast("string")), cell(_dmy(F.col("l_shipdate"))),
                   cell(F.concat(F.lit("Cliente&nbsp;<b>"), F.col("l_suppkey").cast("string"), F.lit("</b> &amp; Cia"))), F.lit("</tr>"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(  # a few lines of one order
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", row.alias("row")))).alias("rows"))
    html = F.concat(F.lit("<table><tr><th>Tarefa</th><th>Data</th><th>Cliente</th></tr>"),
                    F.array_join(F.transform("rows", lambda r: r["row"]), ""),
                    F.lit("<tr><td>Total</td><td>"), F.size("rows").cast("string"), F.lit("</td></tr></table>"))
    return rows.select(F.col("l_orderkey").cast("string").alias("page_key"), html.alias("html"))


#: Date texts by order key: the formats of the shapes, and the parts of the date that each keeps.
DATE_SHAPES = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "d/M/yy", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss.SSS",
               "yyyy-MM-dd HH:mm"]


def date_texts(t: Tables) -> DataFrame:
    """(order_key, texto): order dates at 13:45:07.250 in eight shapes, then texts that are no dates."""
    k = F.pmod(F.col("o_orderkey"), F.lit(len(DATE_SHAPES) + 3))
    at = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.expr("INTERVAL '13:45:07.250' HOUR TO SECOND")
    text = F.when(k == len(DATE_SHAPES), "31/02/2023").when(k == len(DATE_SHAPES) + 1, "sem data").otherwise("  ")
    for n, shape in enumerate(DATE_SHAPES):
        text = F.when(k == n, F.date_format(at, shape)).otherwise(text)
    return t.orders.select(F.col("o_orderkey").alias("order_key"), text.alias("texto"))
