"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their DuckDB oracles.

Every query reads the whole driver tables (through the derived views) with
the fixed ``AS_OF`` date.  ``ORACLE`` holds the equivalent DuckDB SQL.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from fieldlens.operators import kpi
from fieldlens.plans import jobs
from fieldlens.plans import oracle as O
from fieldlens.sources import views as V
from fieldlens.sources.tables import Tables, tables_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tables_for(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------- A6
def _a6_sql(rtm: str) -> str:
    warr = (f"(STATUS_GARANTIA = 'DENTRO' OR ((STATUS_GARANTIA IS NULL OR STATUS_GARANTIA = '') "
            f"AND coalesce(DT_NUM_NF + 365 >= {O.AS_OF_SQL}, false)))")
    elec = f"coalesce(DT_NUM_NF + 365 >= {O.AS_OF_SQL}, false)"

    def metrics(n: str) -> str:
        return f"""{O.pct("count_if(NUM_SERIAL IN (SELECT CHASSI FROM startup_set))", n)} AS start_up_own,
  {O.pct("count_if(NUM_SERIAL IN (SELECT CHASSI FROM call_set))", n)} AS pct_with_tickets,
  {O.pct(f"count_if({warr})", n)} AS pct_under_warranty,
  {O.pct(f"count_if({elec})", n)} AS pct_under_electronic_warranty,
  {O.pct("count_if(NUM_SERIAL IN (SELECT CHASSI FROM error_set))", n)} AS pct_error_rtm_ticket"""

    return O.with_views("units", "startup_set", "call_set", "error_set") + f""",
base AS (SELECT ANO_NF, NUM_SERIAL, DT_NUM_NF, ORDER_KEY, STATUS_GARANTIA FROM units
         WHERE RTM = '{rtm}' AND NUM_SERIAL IS NOT NULL),
yr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ANO_NF, NUM_SERIAL
       ORDER BY DT_NUM_NF NULLS LAST, ORDER_KEY) AS rn FROM base WHERE ANO_NF IS NOT NULL) WHERE rn = 1),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NUM_SERIAL
       ORDER BY DT_NUM_NF NULLS LAST, ORDER_KEY) AS rn FROM base) WHERE rn = 1)
SELECT CAST(ANO_NF AS VARCHAR) AS ano, count(*) AS units_sales, {metrics("count(*)")}
FROM yr GROUP BY ANO_NF
UNION ALL
SELECT 'Total' AS ano, (SELECT count(*) FROM yr) AS units_sales, {metrics("count(*)")}
FROM al HAVING count(*) > 0"""


@register("rtm_analysis_by_year", _a6_sql("SIM"))
def q_rtm_analysis_by_year(t: Tables) -> DataFrame:
    return kpi.rtm_analysis_by_year(_units(t), _tickets(t), _errors(t), "SIM", V.AS_OF)


@register("rtm_analysis_by_year_non_rtm", _a6_sql("NAO"))
def q_rtm_analysis_by_year_non_rtm(t: Tables) -> DataFrame:
    return kpi.rtm_analysis_by_year(_units(t), _tickets(t), _errors(t), "NAO", V.AS_OF)


# ============================================================ helpers
from pyspark.sql import functions as F  # noqa: E402

from fieldlens.functions import expr as E  # noqa: E402
from fieldlens.operators import charts, dedup, filters, joins, relationship  # noqa: E402


def _units(t: Tables, **kw) -> DataFrame:
    key = "units" + "".join(f"_{k}={v}" for k, v in sorted(kw.items()))
    return t.memo(key, lambda: jobs.build_installed_base(t, V.AS_OF, **kw))


def _tickets(t: Tables) -> DataFrame:
    return t.memo("tickets", lambda: jobs.build_tickets(t, V.AS_OF))


def _errors(t: Tables) -> DataFrame:
    return t.memo("errors", lambda: jobs.build_errors(t))


def _tickets_full(t: Tables) -> DataFrame:
    """Tickets with the model and warranty status of their unit."""
    return t.memo("tickets_full", lambda: kpi.tickets_with_units(_tickets(t), _units(t)))


W = O.with_views
P = O.pct

# ============================================================ installed base


@register("rtm_summary", W("units", "tickets_base") + """,
base AS (SELECT * FROM units WHERE RTM = 'SIM' AND NUM_SERIAL IS NOT NULL),
yr AS (SELECT DISTINCT ANO_NF, NUM_SERIAL FROM base WHERE ANO_NF IS NOT NULL),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY NUM_SERIAL ORDER BY DT_NUM_NF NULLS LAST, ORDER_KEY) rn
       FROM base) WHERE rn = 1)
SELECT (SELECT count(*) FROM yr) AS total_units,
       count_if(GARANTIA = 1095 AND STATUS_GARANTIA = 'DENTRO') AS chassis_36m_warranty,
       count_if(coalesce(DT_NUM_NF + 365 >= """ + O.AS_OF_SQL + """, false)) AS chassis_under_electronic_warranty,
       count_if(NUM_SERIAL IN (SELECT CHASSI FROM tickets_base WHERE CHASSI IS NOT NULL)) AS installed_base_known
FROM al""")
def q_rtm_summary(t: Tables) -> DataFrame:
    return kpi.rtm_summary(_units(t), _tickets(t), "SIM", V.AS_OF)


def _distinct_if(cond: str) -> str:
    return f"count(DISTINCT CASE WHEN {cond} THEN NUM_SERIAL END)"


_SU = "NUM_SERIAL IN (SELECT CHASSI FROM startup_set)"
_CA = "NUM_SERIAL IN (SELECT CHASSI FROM call_set)"
_VC = "coalesce((SELECT n FROM valid_counts v WHERE v.CHASSI = u.NUM_SERIAL), 0)"


@register("installed_base_kpis", W("units", "startup_set", "call_set", "valid_counts") + f"""
SELECT {P(_distinct_if(_SU), "count(*)")} AS pct_com_partida_propria,
       {P(f"count_if(NOT ({_SU}) AND {_VC} > 0)", "count(*)")} AS pct_com_partida_terceiros,
       {P(_distinct_if(_CA), "count(*)")} AS pct_com_chamado,
       {P(_distinct_if(f"NOT ({_CA})"), "count(*)")} AS pct_sem_chamado,
       {P(_distinct_if("RTM = 'SIM'"), "count(*)")} AS pct_rtm,
       {P(_distinct_if("STATUS_GARANTIA = 'DENTRO'"), "count(*)")} AS pct_em_garantia,
       {P(_distinct_if("STATUS_GARANTIA = 'FORA'"), "count(*)")} AS pct_fora_garantia
FROM units u""")
def q_installed_base_kpis(t: Tables) -> DataFrame:
    return kpi.installed_base_kpis(_units(t), _tickets(t))


# every unit of the driver tables has tickets: with one order in 40 there are units of all classes
_FEW = "CAST(SS AS BIGINT) % 40 = 1"


def _few_tickets(sql: str) -> str:
    return sql.replace("FROM tickets_base", f"FROM (SELECT * FROM tickets_base WHERE {_FEW})")


_F22_SQL = W("units", "startup_set", "valid_counts") + f"""
SELECT CASE WHEN {_SU} THEN 'SIM - DFS' WHEN {_VC} > 0 THEN 'SIM - TERCEIRO' ELSE 'NÃO' END AS partida_inicial,
       count(*) AS n
FROM units u GROUP BY 1"""


@register("startup_status_counts", _F22_SQL)
def q_startup_status_counts(t: Tables) -> DataFrame:
    return kpi.startup_status_counts(_units(t), _tickets(t))


@register("startup_status_counts_few_tickets", _few_tickets(_F22_SQL))
def q_startup_status_counts_few_tickets(t: Tables) -> DataFrame:
    return kpi.startup_status_counts(_units(t), _tickets(t).where(_FEW))


_G = "TRY_CAST(CAST(GARANTIA AS VARCHAR) AS DOUBLE)"


@register("warranty_distribution", W("units") + "SELECT " + ", ".join(
    f"{P(f'count_if({_G} = {d})', f'count({_G})')} AS pct_{m}m"
    for m, d in ((6, 183), (12, 365), (18, 548), (24, 730), (36, 1095))) + " FROM units")
def q_warranty_distribution(t: Tables) -> DataFrame:
    return kpi.warranty_distribution(_units(t))


def _label_sql(num: str, missing: str) -> str:
    whens = " ".join(f"WHEN CAST({num} AS INTEGER) = {d} THEN '{txt}'" for d, txt in
                     sorted(E.dims.WARRANTY_LABELS.items()))
    valid = f"({num} IS NOT NULL AND NOT isnan({num}) AND {num} >= 0 AND {num} <= 3650)"
    return (f"CASE WHEN {missing} THEN 'Não informado' WHEN NOT coalesce({valid}, false) THEN 'Outros' "
            f"ELSE (CASE WHEN trunc({num}) = 183 THEN '{E.dims.WARRANTY_LABELS[183]}' "
            f"WHEN trunc({num}) = 365 THEN '{E.dims.WARRANTY_LABELS[365]}' "
            f"WHEN trunc({num}) = 548 THEN '{E.dims.WARRANTY_LABELS[548]}' "
            f"WHEN trunc({num}) = 730 THEN '{E.dims.WARRANTY_LABELS[730]}' "
            f"WHEN trunc({num}) = 1095 THEN '{E.dims.WARRANTY_LABELS[1095]}' ELSE 'Outros' END) END")


@register("warranty_labels", W("raw_units") + f"""
SELECT {_label_sql("TRY_CAST(trim(GARANTIA) AS DOUBLE)", "GARANTIA IS NULL OR GARANTIA = ''")} AS duracao_garantia,
       count(*) AS n
FROM raw_units GROUP BY 1""")
def q_warranty_labels(t: Tables) -> DataFrame:
    raw = V.raw_installed_base(t)
    return raw.groupBy(E.warranty_label("GARANTIA", text=True).alias("duracao_garantia")).agg(F.count(F.lit(1)).alias("n"))


@register("warranty_labels_numeric", W("units") + f"""
SELECT {_label_sql("CAST(GARANTIA AS DOUBLE)", "GARANTIA IS NULL OR GARANTIA = 0")} AS duracao_garantia,
       count(*) AS n
FROM units GROUP BY 1""")
def q_warranty_labels_numeric(t: Tables) -> DataFrame:
    return _units(t).groupBy(E.warranty_label("GARANTIA").alias("duracao_garantia")).agg(F.count(F.lit(1)).alias("n"))


@register("warranty_status", W("units") + """
SELECT ORDER_KEY AS order_key, NUM_SERIAL AS num_serial, GARANTIA AS garantia, FIM_GARANTIA AS fim_garantia,
       STATUS_GARANTIA AS status_garantia FROM units""")
def q_warranty_status(t: Tables) -> DataFrame:
    return _units(t).select(F.col("ORDER_KEY").alias("order_key"), F.col("NUM_SERIAL").alias("num_serial"),
                            F.col("GARANTIA").alias("garantia"), F.col("FIM_GARANTIA").alias("fim_garantia"),
                            F.col("STATUS_GARANTIA").alias("status_garantia"))


@register("electronic_warranty", W("units") + f"""
SELECT ORDER_KEY AS order_key, 365 AS garantia_eletronica,
       strftime(DT_NUM_NF + 365, '%d/%m/%Y') AS fim_garan_eletrica,
       CASE WHEN coalesce(DT_NUM_NF + 365 >= {O.AS_OF_SQL}, false) THEN 'DENTRO' ELSE 'FORA' END AS status_garan_eletrica
FROM units""")
def q_electronic_warranty(t: Tables) -> DataFrame:
    u = _units(t)
    return u.select(F.col("ORDER_KEY").alias("order_key"), F.lit(E.dims.ELECTRONIC_WARRANTY_DAYS).alias("garantia_eletronica"),
                    F.date_format(E.electronic_warranty_end("DT_NUM_NF"), "dd/MM/yyyy").alias("fim_garan_eletrica"),
                    E.electronic_warranty_status("DT_NUM_NF", V.AS_OF).alias("status_garan_eletrica"))


@register("error_value_summary", W("errors") + """
SELECT round(coalesce(avg(VALOR_TOTAL), 0), 4) AS media_valor_total, round(coalesce(avg(VALOR_PECA), 0), 4) AS media_valor_peca,
       round(coalesce(sum(VALOR_TOTAL), 0), 4) AS soma_valor_total, round(coalesce(sum(VALOR_PECA), 0), 4) AS soma_valor_peca
FROM errors""")
def q_error_value_summary(t: Tables) -> DataFrame:
    s = kpi.error_value_summary(_errors(t))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


@register("model_share", W("units_all") + "SELECT " + ", ".join(
    [f"{P(f'count_if(MODELO = {chr(39)}{m}{chr(39)})', 'count(*)')} AS pct_{m.lower()}" for m in E.dims.MAIN_MODELS]
    + [f"{P('count_if(MODELO IS NOT NULL AND MODELO NOT IN (' + ', '.join(repr(m) for m in E.dims.MAIN_MODELS) + '))', 'count(*)')} AS pct_others"])
    + " FROM units_all WHERE trim(PAIS) = 'BR'")
def q_model_share(t: Tables) -> DataFrame:
    return kpi.model_share(_units(t, drop_other_models=False))


@register("domestic_units", W("units") + "SELECT MODELO AS modelo, count(*) AS n FROM units GROUP BY 1")
def q_domestic_units(t: Tables) -> DataFrame:
    return _units(t).groupBy(F.col("MODELO").alias("modelo")).agg(F.count(F.lit(1)).alias("n"))


@register("state_share", W("units") + """,
c AS (SELECT UF AS uf, count(*) AS quantidade FROM units WHERE UF IS NOT NULL GROUP BY UF)
SELECT uf, quantidade, round(quantidade / (SELECT sum(quantidade) FROM c) * 100.0, 1) AS percentual,
       round(quantidade / (SELECT sum(quantidade) FROM c) * 100.0, 1) >= 1.0 AS mostrar_rotulo FROM c""")
def q_state_share(t: Tables) -> DataFrame:
    return charts.state_share(_units(t))


# label points of the driver's nations: keys along the equator, regions from south to north
@register("state_points", W("units") + """,
c AS (SELECT UF AS uf, count(*) AS quantidade FROM units WHERE UF IS NOT NULL GROUP BY UF),
s AS (SELECT uf, quantidade, round(quantidade / (SELECT sum(quantidade) FROM c) * 100.0, 1) AS percentual FROM c),
p AS (SELECT n_name AS UF, upper(substr(n_name, 1, 3)) AS nome, n_nationkey * 14.4 - 172.8 AS lon, n_regionkey * 30.0 - 60 AS lat
      FROM nation WHERE n_nationkey <> 7)
SELECT s.uf, nome, quantidade, percentual, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat,
       CASE WHEN percentual >= 1.0 AND lon IS NOT NULL THEN nome || ' ' || printf('%.1f%%', percentual) END AS rotulo
FROM s LEFT JOIN p ON s.uf = p.UF""")
def q_state_points(t: Tables) -> DataFrame:
    points = t.nation.where("n_nationkey <> 7").selectExpr(
        "n_name AS UF", "upper(substr(n_name, 1, 3)) AS NOME", "CAST(n_nationkey * 14.4 - 172.8 AS DOUBLE) AS LON",
        "CAST(n_regionkey * 30.0 - 60 AS DOUBLE) AS LAT")
    return charts.state_points(_units(t), points)


# ============================================================ tickets


@register("ticket_dedup", W("tickets_dedup") + """
SELECT SS, TAREFA, CHASSI, DATA, STATUS, MANTENEDOR, SUMARIO, l_partkey FROM tickets_dedup""")
def q_ticket_dedup(t: Tables) -> DataFrame:
    feed = V.derive_ticket_columns(dedup.latest_per_key(V.ticket_extract(t), V.TICKET_KEYS, V.ticket_order()))
    return V.enrich_ticket_feed(feed, t).select("SS", "TAREFA", "CHASSI", "DATA", "STATUS", "MANTENEDOR", "SUMARIO", "l_partkey")


@register("ticket_dedup_count", W("raw_tickets", "tickets_dedup") + """
SELECT (SELECT count(*) FROM raw_tickets) AS raw_rows, (SELECT count(*) FROM tickets_dedup) AS dedup_rows""")
def q_ticket_dedup_count(t: Tables) -> DataFrame:
    raw = V.raw_tickets(t).agg(F.count(F.lit(1)).alias("raw_rows"))
    d = _tickets(t).agg(F.count(F.lit(1)).alias("dedup_rows"))
    return raw.crossJoin(d)


@register("ticket_kpis", W("tickets") + f"""
SELECT count(*) AS total, count_if(STATUS = 'ABERTO') AS abertos,
       count_if(STATUS IS DISTINCT FROM 'ABERTO') AS fechados, avg(CAST(AGING AS DOUBLE)) AS aging_medio,
       {P("count_if(GARANTIA = 'DENTRO')", "count(*)")} AS pct_garantia,
       {P("count_if(RTM = 'SIM')", "count(*)")} AS pct_rtm
FROM tickets""")
def q_ticket_kpis(t: Tables) -> DataFrame:
    return kpi.ticket_unit_kpis(_tickets(t), _units(t))


@register("ticket_aging", W("tickets_base") + "SELECT SS, TAREFA, STATUS, INICIO, FIM, AGING FROM tickets_base")
def q_ticket_aging(t: Tables) -> DataFrame:
    return _tickets(t).select("SS", "TAREFA", "STATUS", "INICIO", "FIM", "AGING")


_BUCKET = ("CASE WHEN AGING IS NULL OR AGING < 0 THEN NULL WHEN AGING <= 7 THEN 'Até 7' "
           "WHEN AGING <= 14 THEN '8 a 14' ELSE '>14' END")


@register("aging_buckets", W("tickets_base") + f""",
b AS (SELECT * FROM (VALUES ('Até 7', 0), ('8 a 14', 1), ('>14', 2)) v(bucket, bucket_order)),
c AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM tickets_base GROUP BY 1)
SELECT b.bucket, b.bucket_order, coalesce(c.n, 0) AS quantidade FROM b LEFT JOIN c ON b.bucket = c.bucket""")
def q_aging_buckets(t: Tables) -> DataFrame:
    return charts.aging_buckets(_tickets(t))


def _mean_aging_sql(field: str, order: str) -> str:
    return W("tickets_base") + f"""
SELECT {field} AS value, avg(CAST(AGING AS DOUBLE)) AS aging_medio FROM tickets_base WHERE {field} IS NOT NULL
GROUP BY 1 ORDER BY aging_medio {order} NULLS LAST, value LIMIT 20"""


@register("aging_top20_desc", _mean_aging_sql("CHASSI", "DESC"))
def q_aging_top20_desc(t: Tables) -> DataFrame:
    return charts.aging_top_desc(_tickets(t), "CHASSI")


@register("aging_best20_by_maintainer", _mean_aging_sql("MANTENEDOR", "ASC"))
def q_aging_best20_by_maintainer(t: Tables) -> DataFrame:
    return charts.aging_best(_tickets(t), "MANTENEDOR")


@register("aging_best20_by_specialist", _mean_aging_sql("ESPECIALISTA", "ASC"))
def q_aging_best20_by_specialist(t: Tables) -> DataFrame:
    return charts.aging_best(_tickets(t), "ESPECIALISTA")


@register("aging_month_trend", W("tickets_base") + """,
m AS (SELECT strftime(DATA, '%Y-%m') AS ano_mes, MANTENEDOR AS value, avg(CAST(AGING AS DOUBLE)) AS aging
      FROM tickets_base WHERE DATA IS NOT NULL AND MANTENEDOR IS NOT NULL GROUP BY 1, 2 HAVING avg(AGING) IS NOT NULL),
top AS (SELECT value FROM m GROUP BY value ORDER BY count(*) DESC, value LIMIT 10)
SELECT * FROM m WHERE value IN (SELECT value FROM top)""")
def q_aging_month_trend(t: Tables) -> DataFrame:
    return charts.aging_month_trend(_tickets(t), "MANTENEDOR")


@register("value_counts_top20", W("tickets_base") + """
SELECT CHASSI AS value, count(*) AS quantidade FROM tickets_base WHERE CHASSI IS NOT NULL
GROUP BY 1 ORDER BY quantidade DESC, value LIMIT 20""")
def q_value_counts_top20(t: Tables) -> DataFrame:
    return charts.value_counts_top(_tickets(t), "CHASSI")


@register("tag_extract", W("tickets_base") + "SELECT SS, TAREFA, array_to_string(TAGS, '|') AS tags FROM tickets_base")
def q_tag_extract(t: Tables) -> DataFrame:
    return _tickets(t).select("SS", "TAREFA", F.array_join("TAGS", "|").alias("tags"))


@register("tag_counts", W("tickets_base") + """
SELECT tag, count(*) AS quantidade FROM (SELECT unnest(TAGS) AS tag FROM tickets_base)
GROUP BY tag ORDER BY quantidade DESC, tag LIMIT 20""")
def q_tag_counts(t: Tables) -> DataFrame:
    return charts.tag_counts(_tickets(t))


@register("maintainer_lookup", W("tickets_base") + """
SELECT SS, TAREFA, PROPRIETARIO, MANTENEDOR, ESPECIALISTA FROM tickets_base""")
def q_maintainer_lookup(t: Tables) -> DataFrame:
    return _tickets(t).select("SS", "TAREFA", "PROPRIETARIO", "MANTENEDOR", "ESPECIALISTA")


@register("calls_per_unit", W("units", "tickets_base") + """,
s AS (SELECT DISTINCT NUM_SERIAL FROM units WHERE NUM_SERIAL IS NOT NULL),
c AS (SELECT CHASSI, count(*) AS n, count_if(NOT coalesce(regexp_matches(SUMARIO, '\\[STB\\]', 'i'), false)) AS v
      FROM tickets_base WHERE CHASSI IS NOT NULL GROUP BY CHASSI)
SELECT s.NUM_SERIAL AS num_serial, coalesce(c.n, 0) AS qtd_chamados, coalesce(c.v, 0) AS qtd_chamados_validos
FROM s LEFT JOIN c ON s.NUM_SERIAL = c.CHASSI""")
def q_calls_per_unit(t: Tables) -> DataFrame:
    s = _units(t).select("NUM_SERIAL").where(F.col("NUM_SERIAL").isNotNull()).distinct()
    j = kpi._attach_flags(s, kpi.unit_ticket_flags(_tickets(t)))
    return j.select(F.col("NUM_SERIAL").alias("num_serial"), F.col("n_calls").alias("qtd_chamados"),
                    F.col("n_valid_calls").alias("qtd_chamados_validos"))


@register("ticket_numbers_per_unit", W("tickets_base") + """
SELECT DISTINCT CHASSI, SS FROM tickets_base WHERE CHASSI IS NOT NULL AND SS IS NOT NULL""")
def q_ticket_numbers_per_unit(t: Tables) -> DataFrame:
    return joins.ticket_numbers_per_unit(_tickets(t))


# ------------------------------------------------------------ filters
_TAGS_PICK = ["ECONOMY", "BRAND#2"]


@register("filter_tags_exact", W("tickets_base") + """
SELECT SS, TAREFA FROM tickets_base WHERE list_sort(list_distinct(TAGS)) = ['BRAND#2', 'ECONOMY']""")
def q_filter_tags_exact(t: Tables) -> DataFrame:
    return filters.tags_exact(_tickets(t), _TAGS_PICK).select("SS", "TAREFA")


@register("filter_in_lists", W("tickets_base") + """
SELECT SS, TAREFA FROM tickets_base WHERE MANTENEDOR IN ('SAW-01', 'SAW-07', '') AND TIPO IN ('A', 'N')""")
def q_filter_in_lists(t: Tables) -> DataFrame:
    return filters.in_lists(_tickets(t), {"MANTENEDOR": ["SAW-01", "SAW-07", ""], "TIPO": ["A", "N"],
                                          "NAO_EXISTE": ["x"], "STATUS": []}).select("SS", "TAREFA")


@register("filter_status", W("tickets_base") + """
SELECT SS, TAREFA, STATUS FROM tickets_base WHERE STATUS IS DISTINCT FROM 'ABERTO'""")
def q_filter_status(t: Tables) -> DataFrame:
    return filters.by_status(_tickets(t), "FECHADO").select("SS", "TAREFA", "STATUS")


@register("filter_dates", W("tickets_base") + """
SELECT SS, TAREFA FROM tickets_base WHERE INICIO >= TIMESTAMP '1997-01-01' AND FIM <= TIMESTAMP '1998-06-30'""")
def q_filter_dates(t: Tables) -> DataFrame:
    import datetime as dt
    return filters.date_window(_tickets(t), dt.date(1997, 1, 1), dt.date(1998, 6, 30)).select("SS", "TAREFA")


SEARCH_COLUMNS = ["SS", "TAREFA", "CHASSI", "STATUS", "PROPRIETARIO", "MANTENEDOR", "ESPECIALISTA", "SERVICO",
                  "TIPO", "SUMARIO", "RTM", "TAGS", "AGING"]
SEARCH_TERM = "anvil|saw-0[12]|^77$"


def _search_sql(term: str) -> str:
    conds = []
    for c in SEARCH_COLUMNS:
        txt = "array_to_string(TAGS, ', ')" if c == "TAGS" else f"CAST({c} AS VARCHAR)"
        conds.append(f"coalesce(regexp_matches({txt}, '{term}', 'i'), false)")
    return " OR ".join(conds)


@register("search_any_column", W("tickets_base") + f"SELECT SS, TAREFA FROM tickets_base WHERE {_search_sql(SEARCH_TERM)}")
def q_search_any_column(t: Tables) -> DataFrame:
    return filters.search_any_column(_tickets(t), SEARCH_TERM, SEARCH_COLUMNS).select("SS", "TAREFA")


@register("ticket_filter_all", W("tickets_base") + f"""
SELECT SS, TAREFA FROM tickets_base WHERE list_sort(list_distinct(TAGS)) = ['BRAND#2', 'ECONOMY']
  AND TIPO IN ('A', 'R') AND STATUS = 'ABERTO' AND INICIO >= TIMESTAMP '1996-01-01'
  AND ({_search_sql('saw')})""")
def q_ticket_filter_all(t: Tables) -> DataFrame:
    import datetime as dt
    df = filters.ticket_filter(_tickets(t), tags=_TAGS_PICK, selections={"TIPO": ["A", "R"]}, term="",
                               status="ABERTO", start=dt.date(1996, 1, 1))
    return filters.search_any_column(df, "saw", SEARCH_COLUMNS).select("SS", "TAREFA")


_SOME_TAGS, _SOME_TYPES = ["BRAND#7", "ECONOMY"], ["WBP EQUIPAMENTO DOMESTICO", "N"]


@register("ticket_filter_combined", W("tickets_base") + f"""
SELECT SS, TAREFA FROM tickets_base WHERE list_sort(list_distinct(TAGS)) = ['BRAND#7', 'ECONOMY']
  AND TIPO IN ('WBP EQUIPAMENTO DOMESTICO', 'N') AND STATUS = 'ABERTO' AND INICIO >= TIMESTAMP '1996-01-01'
  AND ({_search_sql('saw')})""")
def q_ticket_filter_combined(t: Tables) -> DataFrame:
    """P6 with a selection that some tickets pass."""
    import datetime as dt
    df = filters.ticket_filter(_tickets(t), tags=_SOME_TAGS, selections={"TIPO": _SOME_TYPES}, status="ABERTO",
                               start=dt.date(1996, 1, 1))
    return filters.search_any_column(df, "saw", SEARCH_COLUMNS).select("SS", "TAREFA")


def _p7_sql(cond: str) -> str:
    return W("units", "startup_set", "valid_counts", "tickets_base") + f""",
allc AS (SELECT CHASSI, count(*) AS n FROM tickets_base WHERE CHASSI IS NOT NULL GROUP BY CHASSI)
SELECT ORDER_KEY AS order_key, NUM_SERIAL AS num_serial FROM units u
WHERE RTM = 'SIM' AND ANO_NF BETWEEN 1996 AND 2000 AND ({cond})
  AND NUM_SERIAL IS NOT NULL AND coalesce((SELECT n FROM allc a WHERE a.CHASSI = u.NUM_SERIAL), 0) BETWEEN 0 AND 40"""


def _p7(t: Tables, startup: str, tickets: DataFrame | None = None) -> DataFrame:
    return filters.installed_base_filter(_units(t), _tickets(t) if tickets is None else tickets, rtm="SIM", startup=startup, years=(1996, 2000),
                                         calls=(0, 40)).select(F.col("ORDER_KEY").alias("order_key"),
                                                               F.col("NUM_SERIAL").alias("num_serial"))


@register("installed_base_filter_own", _p7_sql(_SU))
def q_installed_base_filter_own(t: Tables) -> DataFrame:
    return _p7(t, E.dims.STARTUP_OWN)


@register("installed_base_filter_third_party", _p7_sql(f"NOT ({_SU}) AND {_VC} > 0"))
def q_installed_base_filter_third_party(t: Tables) -> DataFrame:
    return _p7(t, E.dims.STARTUP_THIRD_PARTY)


@register("installed_base_filter_none", _p7_sql(f"NOT ({_SU}) AND {_VC} = 0"))
def q_installed_base_filter_none(t: Tables) -> DataFrame:
    return _p7(t, E.dims.STARTUP_NONE)


@register("installed_base_filter_none_few_tickets", _few_tickets(_p7_sql(f"NOT ({_SU}) AND {_VC} = 0")))
def q_installed_base_filter_none_few_tickets(t: Tables) -> DataFrame:
    return _p7(t, E.dims.STARTUP_NONE, _tickets(t).where(_FEW))


@register("error_serial_filter", W("units", "tickets_base", "errors") + """,
e AS (SELECT DISTINCT trim(SS) AS ss FROM errors WHERE TIPO_ERRO IN ('TIPO 1', 'TIPO 3') AND DETALHES_ERRO IN ('ALTO')),
s AS (SELECT DISTINCT CHASSI FROM tickets_base WHERE trim(SS) IN (SELECT ss FROM e) AND CHASSI IS NOT NULL)
SELECT ORDER_KEY AS order_key, NUM_SERIAL AS num_serial FROM units WHERE NUM_SERIAL IN (SELECT CHASSI FROM s)""")
def q_error_serial_filter(t: Tables) -> DataFrame:
    out = filters.error_serial_filter(_units(t), _tickets(t), _errors(t),
                                      {"TIPO_ERRO": ["TIPO 1", "TIPO 3"], "DETALHES_ERRO": ["ALTO"], "COD_ERRO": []})
    return out.select(F.col("ORDER_KEY").alias("order_key"), F.col("NUM_SERIAL").alias("num_serial"))


# ------------------------------------------------------------ relationship
_PREP = W("tickets_base") + """,
prep AS (SELECT trim(coalesce(MANTENEDOR, '')) AS MANTENEDOR, INICIO AS DATA_BASE,
                CASE WHEN AGING < 0 THEN 0 ELSE CAST(AGING AS DOUBLE) END AS AGING_NUM, trim(SS) AS CHAMADO_KEY
         FROM tickets_base
         WHERE trim(coalesce(MANTENEDOR, '')) <> '' AND INICIO IS NOT NULL AND AGING IS NOT NULL)"""


def _prep(t: Tables) -> DataFrame:
    return relationship.prepare_source(_tickets(t), V.AS_OF)


def _cand(t: Tables) -> DataFrame:
    return relationship.prepare_candidates(_tickets(t), V.AS_OF)


@register("last_six_months", _PREP + """
SELECT * FROM prep WHERE DATA_BASE >= (SELECT max(DATA_BASE) FROM prep) - INTERVAL 6 MONTH""")
def q_last_six_months(t: Tables) -> DataFrame:
    return filters.trailing_months(_prep(t), 6)


def _score_sql(v: str, a: str, vc: str, ac: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {a} IS NULL THEN 3 WHEN {v} >= {vc} AND {a} <= {ac} THEN 1 "
            f"WHEN {v} < {vc} AND {a} <= {ac} THEN 2 WHEN {v} < {vc} AND {a} > {ac} THEN 3 ELSE 4 END")


def _label_case(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} = {k} THEN '{v}'" for k, v in E.dims.RELATIONSHIP_SCORE_LABELS.items()) + " END"


_MATRIX = _PREP + """,
m AS (SELECT MANTENEDOR, count(DISTINCT CHAMADO_KEY) AS VOLUME, avg(AGING_NUM) AS AGING_MEDIO_DIAS FROM prep GROUP BY 1),
cuts AS (SELECT median(VOLUME) AS VOLUME_CORTE, median(AGING_MEDIO_DIAS) AS AGING_CORTE FROM m),
s AS (SELECT m.*, cuts.*, """ + _score_sql("VOLUME", "AGING_MEDIO_DIAS", "VOLUME_CORTE", "AGING_CORTE") + """ AS SCORE
      FROM m, cuts)"""


@register("relationship_matrix", _MATRIX + f"""
SELECT MANTENEDOR, VOLUME, round(AGING_MEDIO_DIAS, 1) AS AGING_MEDIO_DIAS, SCORE, {_label_case('SCORE')} AS PERFIL,
       VOLUME_CORTE, AGING_CORTE FROM s""")
def q_relationship_matrix(t: Tables) -> DataFrame:
    return relationship.matrix(_cand(t))


@register("relationship_points", _MATRIX + """,
r AS (SELECT MANTENEDOR, VOLUME, round(AGING_MEDIO_DIAS, 1) AS AGING_MEDIO_DIAS, SCORE FROM s),
p AS (SELECT *, count(*) OVER (PARTITION BY VOLUME, AGING_MEDIO_DIAS) AS DUP_COUNT,
             row_number() OVER (PARTITION BY VOLUME, AGING_MEDIO_DIAS ORDER BY MANTENEDOR) - 1 AS DUP_IDX FROM r),
sp AS (SELECT greatest(max(VOLUME) - min(VOLUME), 1.0) AS xs, greatest(max(AGING_MEDIO_DIAS) - min(AGING_MEDIO_DIAS), 1.0) AS ys FROM r)
SELECT MANTENEDOR, VOLUME, AGING_MEDIO_DIAS, SCORE, DUP_COUNT, DUP_IDX,
       VOLUME + (DUP_IDX - (DUP_COUNT - 1) / 2) * xs * 0.012 AS VOLUME_PLOT,
       AGING_MEDIO_DIAS + (DUP_IDX - (DUP_COUNT - 1) / 2) * ys * 0.012 AS AGING_PLOT FROM p, sp""")
def q_relationship_points(t: Tables) -> DataFrame:
    return relationship.plot_points(relationship.matrix(_cand(t)))


@register("relationship_monthly", _PREP + """,
m AS (SELECT date_trunc('month', DATA_BASE)::DATE AS ANO_MES, MANTENEDOR, count(DISTINCT CHAMADO_KEY) AS VOLUME,
             avg(AGING_NUM) AS AGING_MEDIO_DIAS FROM prep GROUP BY 1, 2),
c AS (SELECT *, median(VOLUME) OVER (PARTITION BY ANO_MES) AS VOLUME_CORTE_MES,
             median(AGING_MEDIO_DIAS) OVER (PARTITION BY ANO_MES) AS AGING_CORTE_MES FROM m)
SELECT ANO_MES, MANTENEDOR, VOLUME, round(AGING_MEDIO_DIAS, 1) AS AGING_MEDIO_DIAS, VOLUME_CORTE_MES, AGING_CORTE_MES,
       """ + _score_sql("VOLUME", "AGING_MEDIO_DIAS", "VOLUME_CORTE_MES", "AGING_CORTE_MES") + " AS SCORE, "
    + _label_case(_score_sql("VOLUME", "AGING_MEDIO_DIAS", "VOLUME_CORTE_MES", "AGING_CORTE_MES")) + " AS PERFIL FROM c")
def q_relationship_monthly(t: Tables) -> DataFrame:
    return relationship.monthly_scores(_cand(t))


# ------------------------------------------------------------ options
@register("filter_options", W("tickets") + """
SELECT DISTINCT field, value FROM (
""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM tickets"
                          for c in charts.TICKET_OPTION_COLUMNS)
    + "\nUNION ALL\nSELECT 'TAGS' AS field, unnest(TAGS) AS value FROM tickets) WHERE value IS NOT NULL")
def q_filter_options(t: Tables) -> DataFrame:
    return charts.filter_options(_tickets_full(t))


@register("filter_option_counts", W("tickets") + """
SELECT field, value, count(*) AS n FROM (
""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM tickets"
                          for c in charts.TICKET_OPTION_COLUMNS)
    + "\nUNION ALL\nSELECT 'TAGS' AS field, unnest(TAGS) AS value FROM tickets) WHERE value IS NOT NULL GROUP BY ALL")
def q_filter_option_counts(t: Tables) -> DataFrame:
    """Three batches: those of one year first, the rest with wrong owners, then the rest as it should be.

    The options of one column do not depend on the others, and a ticket has at most one unit.  So the columns of the unit are
    counted on tickets with units, of which only the keys are shuffled for that join, all others on the tickets themselves.
    """
    first = F.coalesce(F.year("INICIO") < 1995, F.lit(False))
    own = _tickets(t).select("INICIO", *[c for c in charts.TICKET_OPTION_COLUMNS if c not in kpi.UNIT_COLUMNS], "TAGS")
    keys = joins.shared(_tickets(t).select(*kpi.TICKET_ID, "CHASSI", "INICIO"))
    unit = joins.shared(kpi.tickets_with_units(keys, _units(t)).select("INICIO", *kpi.UNIT_COLUMNS))
    rest = joins.shared(own.where(~first))  # read with the wrong and with the right owners

    def batch(tickets: DataFrame, units: DataFrame) -> DataFrame:
        return charts.option_counts(tickets).unionByName(charts.option_counts(units))

    wrong = batch(rest.withColumn("PROPRIETARIO", F.lit("SEM DONO")), unit.where(~first))
    counts = charts.merge_option_counts(batch(own.where(first), unit.where(first)), wrong)
    return charts.merge_option_counts(counts, batch(rest, unit.where(~first)), wrong)


@register("error_options", W("errors") + "SELECT DISTINCT field, value FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM errors" for c in filters.ERROR_FILTER_COLUMNS)
    + ") WHERE value IS NOT NULL AND trim(value) <> ''")
def q_error_options(t: Tables) -> DataFrame:
    return charts.error_options(_errors(t))


@register("installed_base_options", W("units", "tickets_base") + """,
s AS (SELECT DISTINCT NUM_SERIAL FROM units WHERE NUM_SERIAL IS NOT NULL),
c AS (SELECT CHASSI, count(*) AS n FROM tickets_base WHERE CHASSI IS NOT NULL GROUP BY CHASSI),
sc AS (SELECT coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON s.NUM_SERIAL = c.CHASSI)
SELECT 'TODOS,' || array_to_string(list_sort(list_distinct(list(RTM))), ',') AS rtm_options,
       CAST(coalesce(min(ANO_NF), 2000) AS INTEGER) AS ano_min, CAST(coalesce(max(ANO_NF), 2030) AS INTEGER) AS ano_max,
       (SELECT min(n) FROM sc) AS chamados_min, (SELECT max(n) FROM sc) AS chamados_max
FROM units""")
def q_installed_base_options(t: Tables) -> DataFrame:
    return charts.installed_base_options(_units(t), _tickets(t))


# ============================================================ sales reports
from fieldlens.operators import sales  # noqa: E402
from fieldlens.sources import pages as pg  # noqa: E402
from fieldlens.streaming import incremental  # noqa: E402


def _sales(t: Tables) -> DataFrame:
    return t.memo("sales", lambda: V.raw_sales_lines(t))


def _a17_sql(variant: str, mode: str) -> str:
    return W("sales", "item_warranty", "item_rtm") + f""",
wd AS (SELECT ITEM, max(coalesce({O.warranty_days('GARANTIA', mode)}, 0)) AS W_DAYS FROM item_warranty
       WHERE ITEM IS NOT NULL GROUP BY ITEM),
rt AS (SELECT ITEM, bool_or(coalesce(contains(upper(trim(RTM)), 'SIM'), false)) AS IS_RTM FROM item_rtm
       WHERE ITEM IS NOT NULL GROUP BY ITEM),
j AS (SELECT s.ANO, CASE WHEN coalesce(rt.IS_RTM, false) THEN 'RTM' ELSE 'NON_RTM' END AS categoria, s.QTD,
             s.DT + coalesce(wd.W_DAYS, 0) >= {O.AS_OF_SQL} AS norm, s.DT + 365 >= {O.AS_OF_SQL} AS elec
      FROM (SELECT * FROM sales WHERE {O.product(variant)}) s LEFT JOIN wd ON s.ITEM = wd.ITEM
           LEFT JOIN rt ON s.ITEM = rt.ITEM
      WHERE s.DT IS NOT NULL),
g AS (SELECT CASE WHEN grouping(ANO) = 1 THEN 'Total' ELSE CAST(ANO AS VARCHAR) END AS ano, categoria,
             sum(QTD) AS sales, sum(CASE WHEN norm THEN QTD ELSE 0.0 END) AS norm_qty,
             sum(CASE WHEN elec THEN QTD ELSE 0.0 END) AS elec_qty
      FROM j GROUP BY GROUPING SETS ((ANO, categoria), (categoria)))
SELECT *, {P('norm_qty', 'sales')} AS pct_norm, {P('elec_qty', 'sales')} AS pct_elec FROM g"""


def _a17(variant: str, mode: str):
    def fn(t: Tables) -> DataFrame:
        return sales.warranty_sales_by_year(_sales(t), V.item_warranty(t), V.item_rtm(t), V.AS_OF, variant, mode)
    return fn


register("warranty_sales_by_year", _a17_sql("dispenser_w7", "numeric"))(_a17("dispenser_w7", "numeric"))
register("warranty_sales_by_year_w7", _a17_sql("w7", "legacy"))(_a17("w7", "legacy"))
register("warranty_sales_by_year_desc", _a17_sql("bomba", "canonical"))(_a17("bomba", "canonical"))
register("warranty_sales_by_year_segment", _a17_sql("segment", "legacy"))(_a17("segment", "legacy"))


def _blank_coalesce(inline: str, lookup: str, default: str) -> str:
    return (f"coalesce(CASE WHEN NOT ({inline} IS NULL OR trim({inline}) = '' OR trim({inline}) = 'NAO ENCONTRADO') "
            f"THEN {inline} END, {lookup}, '{default}')")


@register("warranty_units_inline_fill", W("sales", "item_warranty", "item_rtm") + f""",
iw AS (SELECT ITEM, max(GARANTIA) AS gw FROM item_warranty GROUP BY ITEM),
ir AS (SELECT ITEM, max(RTM) AS rt FROM item_rtm GROUP BY ITEM),
j AS (SELECT s.*, coalesce({O.warranty_days(_blank_coalesce('s.GARANTIA', 'iw.gw', '0'))}, 0) AS days,
             {_blank_coalesce('s.RTM', 'ir.rt', 'NAO')} = 'SIM' AS is_rtm
      FROM sales s LEFT JOIN iw ON s.ITEM = iw.ITEM LEFT JOIN ir ON s.ITEM = ir.ITEM)
SELECT is_rtm, count(*) AS linhas, sum(QTD) AS quantidade,
       count_if(coalesce(DT + days >= {O.AS_OF_SQL}, false)) AS garantia_ativa,
       count_if(coalesce(DT + 365 >= {O.AS_OF_SQL}, false)) AS garantia_eletronica_ativa
FROM j GROUP BY is_rtm""")
def q_warranty_units_inline_fill(t: Tables) -> DataFrame:
    return sales.units_inline_fill(_sales(t), V.item_warranty(t), V.item_rtm(t), V.AS_OF)


@register("keyword_quantities", W("sales") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS filtro, coalesce(sum(CASE WHEN {O.product(k)} THEN QTD ELSE 0.0 END), 0.0) AS quantidade FROM sales"
    for k in sales.KEYWORD_FILTERS) + ")")
def q_keyword_quantities(t: Tables) -> DataFrame:
    return sales.keyword_quantities(_sales(t))


@register("quantity_by_date_kind", W("sales") + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS tipo_data, CAST(year({O.parse_date(k)}) AS INTEGER) AS ano, sum(QTD) AS quantidade FROM sales "
    f"WHERE {O.parse_date(k)} IS NOT NULL GROUP BY 2" for k in sales.DATE_KINDS) + ")")
def q_quantity_by_date_kind(t: Tables) -> DataFrame:
    return sales.quantity_by_date_kind(_sales(t))


@register("quantity_by_type", W("sales") + "SELECT TIPO AS chave, sum(QTD) AS quantidade FROM sales GROUP BY 1")
def q_quantity_by_type(t: Tables) -> DataFrame:
    return sales.quantity_by(_sales(t), "TIPO")


@register("quantity_by_line", W("sales") + f"""
SELECT LINHA AS chave, sum(QTD) AS quantidade FROM sales WHERE {O.product('bomba_medidora')} GROUP BY 1""")
def q_quantity_by_line(t: Tables) -> DataFrame:
    return sales.quantity_by(_sales(t), "LINHA", "bomba_medidora")


@register("rtm_split", W("sales", "item_rtm") + f""",
rt AS (SELECT ITEM, bool_or(coalesce(contains(upper(trim(RTM)), 'SIM'), false)) AS IS_RTM FROM item_rtm GROUP BY ITEM),
j AS (SELECT CASE WHEN coalesce(rt.IS_RTM, false) THEN 'RTM' ELSE 'NON_RTM' END AS categoria, QTD
      FROM sales s LEFT JOIN rt ON s.ITEM = rt.ITEM WHERE {O.product('bomba_medidora')})
SELECT CASE WHEN grouping(categoria) = 1 THEN 'TOTAL' ELSE categoria END AS categoria, sum(QTD) AS quantidade
FROM j GROUP BY GROUPING SETS ((categoria), ())""")
def q_rtm_split(t: Tables) -> DataFrame:
    return sales.rtm_split(_sales(t), V.item_rtm(t))


@register("rtm_split_w7_bomba_medidora", W("sales", "item_rtm") + f""",
rt AS (SELECT ITEM, bool_or(coalesce(contains(upper(trim(RTM)), 'SIM'), false)) AS IS_RTM FROM item_rtm GROUP BY ITEM),
j AS (SELECT CASE WHEN coalesce(rt.IS_RTM, false) THEN 'RTM' ELSE 'NON_RTM' END AS categoria, QTD
      FROM (SELECT * FROM sales WHERE {O.product('w7_bomba_medidora')}) s LEFT JOIN rt ON s.ITEM = rt.ITEM)
SELECT CASE WHEN grouping(categoria) = 1 THEN 'TOTAL' ELSE categoria END AS categoria, sum(QTD) AS quantidade
FROM j GROUP BY GROUPING SETS ((categoria), ())""")
def q_rtm_split_w7_bomba_medidora(t: Tables) -> DataFrame:
    return sales.rtm_split(_sales(t), V.item_rtm(t), "w7_bomba_medidora")


@register("top20_items", W("sales") + f"""
SELECT LINHA, ITEM, DESCRICAO, sum(QTD) AS quantidade, (SELECT sum(QTD) FROM sales WHERE {O.product('w7')}) AS total
FROM sales WHERE {O.product('w7')}
GROUP BY 1, 2, 3 ORDER BY quantidade DESC, LINHA, ITEM, DESCRICAO LIMIT 20""")
def q_top20_items(t: Tables) -> DataFrame:
    return sales.top_items(_sales(t), "w7")


_RTM_ITEMS = "(SELECT ITEM FROM item_rtm GROUP BY ITEM HAVING bool_or(coalesce(contains(upper(trim(RTM)), 'SIM'), false)))"


@register("rtm_items_ranked", W("sales", "item_rtm") + f"""
SELECT ITEM, sum(QTD) AS quantidade FROM sales WHERE ITEM IN {_RTM_ITEMS} GROUP BY ITEM""")
def q_rtm_items_ranked(t: Tables) -> DataFrame:
    return sales.rtm_items_ranked(_sales(t), V.item_rtm(t))


@register("rtm_items_top20", W("sales", "item_rtm") + f"""
SELECT ITEM, sum(QTD) AS quantidade FROM sales WHERE ITEM IN {_RTM_ITEMS} GROUP BY ITEM ORDER BY quantidade DESC, ITEM LIMIT 20""")
def q_rtm_items_top20(t: Tables) -> DataFrame:
    return sales.rtm_items_ranked(_sales(t), V.item_rtm(t), top=20)


@register("filter_gap_audit", W("sales", "item_rtm") + f""",
x AS (SELECT *, {O.product('segment')} AS ps, {O.product('w7')} AS pw, {O.product('bomba_medidora')} AS pb FROM sales
      WHERE ITEM IN {_RTM_ITEMS})
SELECT ITEM, DESCRICAO, sum(QTD) AS quantidade, sum(CAST(ps AS INTEGER)) AS passa_segmento,
       sum(CAST(pw AS INTEGER)) AS passa_item, sum(CAST(pb AS INTEGER)) AS passa_descricao
FROM x WHERE NOT (pw AND pb) GROUP BY 1, 2
ORDER BY quantidade DESC, ITEM, DESCRICAO LIMIT 20""")
def q_filter_gap_audit(t: Tables) -> DataFrame:
    return sales.filter_gap_audit(_sales(t), V.item_rtm(t))


@register("lookup_miss_report", W("sales", "item_rtm") + f""",
ir AS (SELECT ITEM, max(upper(trim(RTM))) AS rt FROM item_rtm GROUP BY ITEM)
SELECT s.ITEM, s.DESCRICAO, coalesce(ir.rt, 'NAO (Cache Miss)') AS status_rtm, sum(QTD) AS quantidade
FROM sales s LEFT JOIN ir ON s.ITEM = ir.ITEM
WHERE s.ANO = 1996 AND coalesce(contains(upper(SEGMENTO), 'DISPENSER'), false) AND coalesce(starts_with(upper(s.ITEM), 'W7'), false)
  AND NOT contains(coalesce(ir.rt, 'NAO (Cache Miss)'), 'SIM')
GROUP BY 1, 2, 3 ORDER BY quantidade DESC, s.ITEM, s.DESCRICAO LIMIT 20""")
def q_lookup_miss_report(t: Tables) -> DataFrame:
    return sales.lookup_miss_report(_sales(t), V.item_rtm(t), year=1996)


@register("service_excluded_total", W("sales") + f"""
SELECT count(*) AS linhas, coalesce(sum(QTD), 0.0) AS quantidade FROM sales
WHERE {O.product('w7')} AND NOT coalesce(regexp_matches(DESCRICAO, 'SERVICO|MANUTENCAO', 'i'), false)""")
def q_service_excluded_total(t: Tables) -> DataFrame:
    return sales.service_excluded_total(_sales(t))


@register("sample_lines", W("sales", "item_rtm") + """,
ir AS (SELECT ITEM, max(upper(trim(RTM))) AS rt FROM item_rtm GROUP BY ITEM)
SELECT s.LINHA, s.ITEM, s.DESCRICAO, s.QTD AS quantidade, coalesce(ir.rt, 'NAO') AS status_rtm
FROM (SELECT * FROM sales WHERE ANO = 1996 ORDER BY LINHA NULLS LAST, ITEM NULLS LAST, DESCRICAO NULLS LAST, QTD NULLS LAST LIMIT 5) s
LEFT JOIN ir ON s.ITEM = ir.ITEM""")
def q_sample_lines(t: Tables) -> DataFrame:
    return sales.sample_lines(_sales(t), V.item_rtm(t), year=1996)


@register("lines_per_year", W("sales") + "SELECT DISTINCT ANO, LINHA FROM sales WHERE ANO IS NOT NULL")
def q_lines_per_year(t: Tables) -> DataFrame:
    return sales.lines_per_year(_sales(t))


@register("rows_per_year", W("sales") + "SELECT ANO, count(*) AS linhas FROM sales GROUP BY ANO")
def q_rows_per_year(t: Tables) -> DataFrame:
    return sales.rows_per_year(_sales(t))


@register("date_range", W("sales_raw") + "SELECT " + ", ".join(
    f"{f}({O.parse_date(c)}) AS {f}_{c.lower()}" for c in sales.DATE_KINDS for f in ("min", "max")) + " FROM sales_raw")
def q_date_range(t: Tables) -> DataFrame:
    return sales.date_range(_sales(t))


@register("warranty_text_to_days", W("item_warranty") + f"""
SELECT ITEM, GARANTIA, {O.warranty_days('GARANTIA', 'canonical')} AS dias,
       {O.warranty_days('GARANTIA', 'legacy')} AS dias_legado, {O.warranty_days('GARANTIA', 'numeric')} AS dias_numerico
FROM item_warranty""")
def q_warranty_text_to_days(t: Tables) -> DataFrame:
    iw = V.item_warranty(t)
    return iw.select("ITEM", "GARANTIA", E.warranty_text_to_days("GARANTIA", "canonical").alias("dias"),
                     E.warranty_text_to_days("GARANTIA", "legacy").alias("dias_legado"),
                     E.warranty_text_to_days("GARANTIA", "numeric").alias("dias_numerico"))


_ENRICH_YEAR = 1998


@register("items_to_look_up", W("sales", "item_warranty") + f"""
SELECT DISTINCT ITEM FROM sales WHERE ANO >= {_ENRICH_YEAR} AND (GARANTIA IS NULL OR trim(GARANTIA) = '')
  AND ITEM IS NOT NULL AND ITEM NOT IN (SELECT ITEM FROM item_warranty WHERE ITEM IS NOT NULL)""")
def q_items_to_look_up(t: Tables) -> DataFrame:
    return sales.items_to_look_up(_sales(t), V.item_warranty(t), _ENRICH_YEAR)


@register("enrichment_report", W("sales", "item_warranty") + f""",
need AS (SELECT ITEM, count(*) AS n FROM sales WHERE ANO >= {_ENRICH_YEAR} AND (GARANTIA IS NULL OR trim(GARANTIA) = '')
         AND ITEM IS NOT NULL GROUP BY ITEM),
j AS (SELECT need.*, ITEM IN (SELECT ITEM FROM item_warranty WHERE ITEM IS NOT NULL) AS hit FROM need)
SELECT coalesce(sum(n), 0) AS linhas_a_verificar, count(*) AS itens_unicos, count_if(hit) AS em_cache,
       count(*) - count_if(hit) AS a_buscar, {P('count_if(hit)', 'count(*)')} AS pct_economia FROM j""")
def q_enrichment_report(t: Tables) -> DataFrame:
    return sales.enrichment_report(_sales(t), V.item_warranty(t), _ENRICH_YEAR)


def _unpacked(t: Tables) -> DataFrame:
    """Lines already unpacked: those of finished orders (o_orderstatus = 'F')."""
    o = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("PEDIDO"))
    return _sales(t).join(o, "PEDIDO", "left_semi").select("PEDIDO", "LINHA", "ITEM")


@register("lines_not_unpacked", W("sales_raw") + """
SELECT PEDIDO, LINHA, ITEM FROM sales_raw s WHERE NOT EXISTS (
  SELECT 1 FROM sales_raw d JOIN orders o ON d.PEDIDO = CAST(o.o_orderkey AS VARCHAR) AND o.o_orderstatus = 'F'
  WHERE trim(d.PEDIDO) = trim(s.PEDIDO) AND trim(d.LINHA) = trim(s.LINHA) AND trim(d.ITEM) = trim(s.ITEM))""")
def q_lines_not_unpacked(t: Tables) -> DataFrame:
    return joins.not_yet_processed(_sales(t), _unpacked(t), ["PEDIDO", "LINHA", "ITEM"]).select("PEDIDO", "LINHA", "ITEM")


# ============================================================ pages
@register("serials_from_pages", W("sales_raw", "serial_pages") + f""",
p AS (SELECT page_key, {O.serials_in_page('max(html)')} AS serials FROM serial_pages GROUP BY page_key),
l AS (SELECT DISTINCT PEDIDO, LINHA, ITEM FROM sales_raw)
SELECT s.PEDIDO, s.LINHA, s.ITEM, CASE WHEN len(p.serials) = 0 THEN '' ELSE u.serial END AS Serial
FROM l s JOIN p ON s.PEDIDO || '/' || s.LINHA = p.page_key
LEFT JOIN LATERAL (SELECT unnest(CASE WHEN len(p.serials) = 0 THEN [''] ELSE p.serials END) AS serial) u ON true""")
def q_serials_from_pages(t: Tables) -> DataFrame:
    lines = _sales(t).select("PEDIDO", "LINHA", "ITEM").withColumn("_key", F.concat("PEDIDO", F.lit("/"), "LINHA"))
    return pg.unpack_serials(lines, V.serial_pages(t), "_key").drop("_key")


@register("flag_from_pages", W("item_pages") + """
SELECT page_key, CASE WHEN coalesce(regexp_matches(upper(html), 'BLUETOOTH|BLUETOOH'), false) THEN 'SIM' ELSE 'NAO' END AS RTM
FROM item_pages""")
def q_flag_from_pages(t: Tables) -> DataFrame:
    return pg.page_flags(V.item_pages(t), "page_key").select("page_key", "RTM")


@register("warranty_from_pages", W("item_pages") + f""",
x AS (SELECT page_key, {O.warranty_sentence('html')} AS GARANTIA_TEXTO FROM item_pages)
SELECT page_key, GARANTIA_TEXTO, {O.warranty_days('GARANTIA_TEXTO', 'canonical')} AS dias FROM x""")
def q_warranty_from_pages(t: Tables) -> DataFrame:
    p = pg.page_flags(V.item_pages(t), "page_key")
    return p.select("page_key", "GARANTIA_TEXTO", E.warranty_text_to_days("GARANTIA_TEXTO").alias("dias"))


# ============================================================ incremental
@register("oldest_open", W("tickets_base") + f"""
SELECT coalesce(min(CASE WHEN upper(STATUS) = 'ABERTO' THEN CAST(DATA AS DATE) END), {O.AS_OF_SQL}) AS oldest_open
FROM tickets_base""")
def q_oldest_open(t: Tables) -> DataFrame:
    return incremental.oldest_open(_tickets(t), V.AS_OF)


_WM = f"(SELECT coalesce(min(CASE WHEN upper(STATUS) = 'ABERTO' THEN CAST(DATA AS DATE) END), {O.AS_OF_SQL}) FROM tickets_base)"


@register("month_ranges", W("tickets_base") + f""",
w AS (SELECT {_WM} AS wm),
m AS (SELECT CAST(unnest(generate_series(date_trunc('month', wm), date_trunc('month', {O.AS_OF_SQL}), INTERVAL 1 MONTH)) AS DATE) AS mes, wm FROM w)
SELECT mes, greatest(mes, wm) AS inicio, least(last_day(mes), {O.AS_OF_SQL}) AS fim FROM m""")
def q_month_ranges(t: Tables) -> DataFrame:
    return incremental.month_ranges(incremental.oldest_open(_tickets(t), V.AS_OF), V.AS_OF)


@register("ticket_resplit", W("tickets_base") + f""",
w AS (SELECT {_WM} AS wm)
SELECT CASE WHEN DATA IS NULL THEN NULL WHEN upper(STATUS) <> 'ABERTO' AND CAST(DATA AS DATE) < wm THEN 'historico'
            WHEN CAST(DATA AS DATE) >= wm THEN 'atual' END AS destino, count(*) AS n
FROM tickets_base, w GROUP BY 1""")
def q_ticket_resplit(t: Tables) -> DataFrame:
    tk = _tickets(t)
    r = incremental.resplit(tk, incremental.oldest_open(tk, V.AS_OF))
    return r.groupBy("destino").agg(F.count(F.lit(1)).alias("n"))


# what was fetched before and what is fetched now, from the same tickets: rows only in one of them,
# reopened, closed and reassigned tickets, unknown status, dates that are missing or known since
_K = "(CAST(SS AS BIGINT) * 7 + CAST(TAREFA AS BIGINT))"
_NIGHT_SQL = f"""
fetched AS (SELECT SS, TAREFA, CASE WHEN {_K} % 17 = 3 THEN NULL ELSE STATUS END AS STATUS, MANTENEDOR,
                   CASE WHEN {_K} % 19 = 2 THEN NULL ELSE DATA END AS DATA FROM tickets_base WHERE {_K} % 5 NOT IN (1, 4)),
base AS (SELECT SS, TAREFA, CASE WHEN {_K} % 7 = 1 THEN 'FECHADO' WHEN {_K} % 7 = 2 THEN 'ABERTO' WHEN {_K} % 11 = 4 THEN NULL ELSE STATUS END AS STATUS,
                CASE WHEN {_K} % 7 = 3 THEN 'ANTES' ELSE MANTENEDOR END AS MANTENEDOR,
                CASE WHEN {_K} % 13 = 5 THEN NULL ELSE DATA END AS DATA FROM tickets_base WHERE {_K} % 5 NOT IN (0, 4)),
old AS (SELECT SS, TAREFA, 'FECHADO' AS STATUS, 'HISTORICO' AS MANTENEDOR, DATA FROM tickets_base WHERE {_K} % 5 IN (2, 4)),
latest AS (SELECT * FROM fetched UNION ALL SELECT * FROM base WHERE (SS, TAREFA) NOT IN (SELECT (SS, TAREFA) FROM fetched)),
w AS (SELECT coalesce(min(CASE WHEN upper(STATUS) = 'ABERTO' THEN CAST(DATA AS DATE) END), {O.AS_OF_SQL}) AS wm FROM latest),
result AS (SELECT CASE WHEN DATA IS NULL THEN 'rejects' WHEN (STATUS IS NULL OR upper(STATUS) <> 'ABERTO') AND CAST(DATA AS DATE) < wm THEN 'history'
             WHEN CAST(DATA AS DATE) >= wm THEN 'current' END AS part, SS, TAREFA, STATUS, MANTENEDOR, CAST(DATA AS DATE) AS dia FROM latest, w
      UNION ALL SELECT 'history', SS, TAREFA, STATUS, MANTENEDOR, CAST(DATA AS DATE) FROM old WHERE (SS, TAREFA) NOT IN (SELECT (SS, TAREFA) FROM latest)
      UNION ALL SELECT 'watermark', NULL, NULL, NULL, NULL, wm FROM w)
SELECT * FROM result WHERE part IS NOT NULL"""


def _nights(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(newly fetched, base, history) of an update that changes much."""
    tk = joins.shared(_tickets(t).select("SS", "TAREFA", "STATUS", "MANTENEDOR", "DATA", F.expr(_K).alias("_k")))
    k = F.col("_k")
    null = F.lit(None)
    status, who, day = F.col("STATUS"), F.col("MANTENEDOR"), F.col("DATA")

    def rows(of: Column, status: Column, who: Column, day: Column) -> DataFrame:
        return tk.where(of).select("SS", "TAREFA", status.alias("STATUS"), who.alias("MANTENEDOR"), day.alias("DATA"))

    fetched = rows(~(k % 5).isin(1, 4), F.when(k % 17 == 3, null).otherwise(status), who, F.when(k % 19 == 2, null).otherwise(day))
    base = rows(~(k % 5).isin(0, 4), F.when(k % 7 == 1, "FECHADO").when(k % 7 == 2, "ABERTO").when(k % 11 == 4, null).otherwise(status),
                F.when(k % 7 == 3, "ANTES").otherwise(who), F.when(k % 13 == 5, null).otherwise(day))
    return fetched, base, rows((k % 5).isin(2, 4), F.lit("FECHADO"), F.lit("HISTORICO"), day)


def _night_rows(parts: dict[str, DataFrame]) -> DataFrame:
    day = F.col("DATA").cast("date").alias("dia")
    every = [parts[n].select(F.lit(n).alias("part"), "SS", "TAREFA", "STATUS", "MANTENEDOR", day) for n in ("history", "current", "rejects")]
    none = F.lit(None).cast("string")
    every.append(parts["watermark"].select(F.lit("watermark").alias("part"), none.alias("SS"), none.alias("TAREFA"), none.alias("STATUS"),
                                           none.alias("MANTENEDOR"), F.col("oldest_open").alias("dia")))
    return reduce(DataFrame.unionByName, every)


@register("update_tickets", W("tickets_base") + "," + _NIGHT_SQL)
def q_update_tickets(t: Tables) -> DataFrame:
    """The row that arrived last wins whatever its date; where each ticket goes, and the new watermark."""
    fetched, base, old = _nights(t)
    return _night_rows(incremental.update_tickets(fetched, base, old, V.AS_OF, ["SS", "TAREFA"], [F.col("DATA")]))


@register("update_tickets_again", W("tickets_base") + "," + _NIGHT_SQL)
def q_update_tickets_again(t: Tables) -> DataFrame:
    """C6 run twice over the same report rows: the second night changes nothing."""
    fetched, base, old = _nights(t)
    keys, order = ["SS", "TAREFA"], [F.col("DATA")]
    once = incremental.update_tickets(fetched, base, old, V.AS_OF, keys, order)
    return _night_rows(incremental.update_tickets(fetched, once["current"].unionByName(once["rejects"]), once["history"],
                                                  V.AS_OF, keys, order))


@register("fill_lines_from_cache", W("sales_raw", "item_warranty") + """,
c AS (SELECT ITEM, max(GARANTIA) AS g FROM item_warranty WHERE GARANTIA IS NOT NULL GROUP BY ITEM)
SELECT s.PEDIDO, s.LINHA, s.ITEM, CASE WHEN s.GARANTIA IS NULL OR trim(s.GARANTIA) = '' OR upper(trim(s.GARANTIA)) = 'NAO ENCONTRADO'
       THEN coalesce(c.g, 'NAO ENCONTRADO') ELSE s.GARANTIA END AS GARANTIA
FROM sales_raw s LEFT JOIN c ON s.ITEM = c.ITEM""")
def q_fill_lines_from_cache(t: Tables) -> DataFrame:
    return jobs.fill_lines(_sales(t), V.item_warranty(t), "GARANTIA", "NAO ENCONTRADO").select("PEDIDO", "LINHA", "ITEM", "GARANTIA")


@register("units_from_year", W("units") + "SELECT ANO_NF AS ano, count(*) AS n FROM units WHERE ANO_NF >= 1996 GROUP BY 1")
def q_units_from_year(t: Tables) -> DataFrame:
    """P11 over the installed base."""
    from fieldlens.operators import filters
    return filters.from_year(_units(t), 1996).groupBy(F.col("ANO_NF").alias("ano")).agg(F.count(F.lit(1)).alias("n"))


@register("union_of_extracts", W("sales_raw") + """,
a AS (SELECT PEDIDO, LINHA, ITEM, GARANTIA FROM sales_raw WHERE CAST(LINHA AS INTEGER) <= 3),
b AS (SELECT ITEM, PEDIDO, LINHA, RTM FROM sales_raw WHERE CAST(LINHA AS INTEGER) > 3)
SELECT 'common' AS kind, count(*) AS n, count(ITEM) AS n_item, 0 AS n_garantia, 0 AS n_rtm FROM
  (SELECT PEDIDO, LINHA, ITEM FROM a UNION ALL SELECT PEDIDO, LINHA, ITEM FROM b)
UNION ALL SELECT 'all', count(*), count(ITEM), count(GARANTIA), count(RTM) FROM
  (SELECT PEDIDO, LINHA, ITEM, GARANTIA, NULL AS RTM FROM a UNION ALL SELECT PEDIDO, LINHA, ITEM, NULL, RTM FROM b)""")
def q_union_of_extracts(t: Tables) -> DataFrame:
    """Two extracts with different columns, on the shared ones and on all of them."""
    from fieldlens.sources import files
    s = _sales(t)
    a = s.where(F.col("LINHA").cast("int") <= 3).select("PEDIDO", "LINHA", "ITEM", "GARANTIA")
    b = s.where(F.col("LINHA").cast("int") > 3).select("ITEM", "PEDIDO", "LINHA", "RTM")
    none = F.lit(0).cast("long")
    common = files.union_common(a, b).agg(F.count(F.lit(1)).alias("n"), F.count("ITEM").alias("n_item"))
    every = files.union_all_columns(a, b).agg(F.count(F.lit(1)).alias("n"), F.count("ITEM").alias("n_item"),
                                              F.count("GARANTIA").alias("n_garantia"), F.count("RTM").alias("n_rtm"))
    return (common.select(F.lit("common").alias("kind"), "n", "n_item", none.alias("n_garantia"), none.alias("n_rtm"))
            .unionByName(every.withColumn("kind", F.lit("all"))))


@register("serial_append_rerun", W("sales_raw", "serial_pages") + f""",
p AS (SELECT page_key, {O.serials_in_page('max(html)')} AS serials FROM serial_pages GROUP BY page_key),
l AS (SELECT DISTINCT PEDIDO, LINHA, ITEM FROM sales_raw),
u AS (SELECT PEDIDO, LINHA, ITEM, unnest(CASE WHEN len(serials) = 0 THEN [''] ELSE serials END) AS Serial
      FROM l JOIN p ON PEDIDO || '/' || LINHA = page_key)
SELECT LINHA, count(*) AS n, count(DISTINCT PEDIDO || '|' || ITEM || '|' || Serial) AS n_rows FROM u GROUP BY LINHA""")
def q_serial_append_rerun(t: Tables) -> DataFrame:
    """Every unpacked row appended to a table that holds part of them already gives each row once."""
    lines = _sales(t).select("PEDIDO", "LINHA", "ITEM").withColumn("_key", F.concat("PEDIDO", F.lit("/"), "LINHA"))
    rows = pg.unpack_serials(lines, V.serial_pages(t), "_key").drop("_key")
    there = rows.where(F.col("LINHA").cast("int") % 2 == 0)
    keys = ["PEDIDO", "LINHA", "ITEM", "Serial"]
    after = there.unionByName(incremental.append_new(there, rows, keys))
    per_row = after.groupBy("LINHA", "PEDIDO", "ITEM", "Serial").agg(F.count(F.lit(1)).alias("k"))
    return per_row.groupBy("LINHA").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_rows"))


@register("unpack_serials", W("sales_raw", "serial_pages") + f""",
p AS (SELECT page_key, {O.serials_in_page('max(html)')} AS serials FROM serial_pages GROUP BY page_key),
l AS (SELECT DISTINCT PEDIDO, LINHA, ITEM FROM sales_raw WHERE TRY_CAST(regexp_extract(DT_NUM_NF, '(\\d{{4}})', 1) AS INTEGER) >= 1996)
SELECT PEDIDO, LINHA, ITEM, unnest(CASE WHEN len(serials) = 0 THEN [''] ELSE serials END) AS Serial
FROM l JOIN p ON PEDIDO || '/' || LINHA = page_key""")
def q_unpack_serials(t: Tables) -> DataFrame:
    """C3 in two runs: P11, J5, S11, J12 and S14; the second run finds the lines that the first had no pages of."""
    lines = sales.lines_from_year(_sales(t), 1996).select("PEDIDO", "LINHA", "ITEM", F.concat("PEDIDO", F.lit("/"), "LINHA").alias("_key"))
    every = V.serial_pages(t)
    some = every.where(F.crc32("page_key") % 3 != 0)
    first = pg.unpack_serials(lines, some, "_key")
    second = jobs.unpack_new_serials(lines, first, every, "_key", jobs.SERIAL_KEYS)
    return first.unionByName(second).drop("_key")


# ============================================================ scalar functions
from fieldlens.operators import profile  # noqa: E402
from fieldlens.streaming import twin  # noqa: E402


@register("address_state", W("raw_units") + """
SELECT ORDER_KEY AS order_key, nullif(regexp_extract(ENDERECO, ',\\s*([A-Z]{2}),\\s*BR', 1), '') AS uf,
       nullif(regexp_extract(trim(ENDERECO), ',\\s*([A-Z]{2})\\s*$', 1), '') AS pais FROM raw_units""")
def q_address_state(t: Tables) -> DataFrame:
    u = V.raw_installed_base(t)
    return u.select(F.col("ORDER_KEY").alias("order_key"), E.state_from_address("ENDERECO").alias("uf"),
                    E.country_from_address("ENDERECO").alias("pais"))


@register("address_country", W("raw_units") + """
SELECT nullif(regexp_extract(trim(ENDERECO), ',\\s*([A-Z]{2})\\s*$', 1), '') AS pais, count(*) AS n
FROM raw_units GROUP BY 1""")
def q_address_country(t: Tables) -> DataFrame:
    u = V.raw_installed_base(t)
    return u.groupBy(E.country_from_address("ENDERECO").alias("pais")).agg(F.count(F.lit(1)).alias("n"))


@register("item_code", W("sales_raw") + f"""
SELECT PEDIDO, LINHA, CASE WHEN starts_with(trim(DESCRICAO), '{E.dims.PUMP_DESCRIPTION_PREFIX}')
       THEN trim(split_part(trim(DESCRICAO), '-', 2)) ELSE '' END AS codigo FROM sales_raw""")
def q_item_code(t: Tables) -> DataFrame:
    return _sales(t).select("PEDIDO", "LINHA", E.pump_code("DESCRICAO").alias("codigo"))


def _sheet_value_spark(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey") % 4
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit(E.dims.SPREADSHEET_EPOCH).cast("date")).cast("string")
    v = (F.when(k == 0, serial).when(k == 1, F.concat(serial, F.lit(",5")))
         .when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("sem data")))
    return o.select(F.col("o_orderkey").alias("order_key"), v.alias("valor"))


_SHEET_SQL = """
SELECT o_orderkey AS order_key,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)
            WHEN 1 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) || ',5'
            WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'sem data' END AS valor FROM orders"""


@register("spreadsheet_dates", "WITH v AS (" + _SHEET_SQL + """),
n AS (SELECT *, TRY_CAST(replace(trim(valor), ',', '.') AS DOUBLE) AS num FROM v)
SELECT order_key, valor, CASE WHEN num IS NOT NULL
         THEN strftime(DATE '1899-12-30' + CAST(floor(num) AS INTEGER), '%d/%m/%Y')
         ELSE coalesce(strftime(""" + O.parse_date("valor") + """, '%d/%m/%Y'), valor, '') END AS data_formatada FROM n""")
def q_spreadsheet_dates(t: Tables) -> DataFrame:
    v = _sheet_value_spark(t)
    return v.select("order_key", "valor", E.spreadsheet_date_text("valor").alias("data_formatada"))


@register("currency_text", """
SELECT o_orderkey AS order_key, 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS valor_texto
FROM orders""")
def q_currency_text(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("order_key"), E.currency_text("o_totalprice").alias("valor_texto"))


@register("model_extract", W("sales_raw") + f"""
SELECT DISTINCT ITEM, {O.item_prefix('ITEM')} AS prefixo, {O.model_case(O.item_prefix('ITEM'))} AS modelo FROM sales_raw""")
def q_model_extract(t: Tables) -> DataFrame:
    s = _sales(t).select("ITEM").distinct()
    return s.select("ITEM", E.item_prefix("ITEM").alias("prefixo"),
                    E.model_from_prefix(E.item_prefix("ITEM")).alias("modelo"))


_PROFILE_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                  "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@register("table_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS coluna, '{ty}' AS tipo, sum(n)::BIGINT AS linhas, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS nulos,
count(v) AS distintos, min(v) AS exemplo_menor, arg_max(v, (n, v)) AS exemplo_frequente, max(v) AS exemplo_maior
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1)"""
    for c, ty in _PROFILE_TYPES.items()))
def q_table_profile(t: Tables) -> DataFrame:
    return profile.table_profile(t.orders)


_FEED_COLS = ["SS", "TAREFA", "l_partkey", "l_suppkey", "l_extendedprice", "DATA", "STATUS"]


@register("stream_equals_batch", W("tickets_dedup") + "SELECT " + ", ".join(_FEED_COLS) + " FROM tickets_dedup")
def q_stream_equals_batch(t: Tables) -> DataFrame:
    """M4: the ticket feed is landed as several extract files (one per ship
    year); a file stream merges them into key-hashed partitions; the drained
    result must equal the batch dedup.  A stream has to run before its result
    can be returned, so this row alone works while the query is built."""
    spark = t.spark
    root = twin.scratch_dir(spark, "tickets-stream")
    feed = (V.ticket_feed(t).withColumn("SS", F.col("l_orderkey").cast("string"))
            .withColumn("TAREFA", F.col("l_linenumber").cast("string")).select(*_FEED_COLS)
            .withColumn("_y", F.year("DATA")))
    feed.write.partitionBy("_y").parquet(os.path.join(root, "landing"))
    schema = spark.read.parquet(os.path.join(root, "landing")).drop("_y").schema
    src = os.path.join(root, "landing", "*")
    # several extract files per micro-batch, still more than one batch: later
    # batches meet the winners of earlier ones in the table
    out = os.path.join(root, "result")
    twin.upsert_stream(spark, src, schema, ["SS", "TAREFA"], ["DATA", "l_partkey", "l_suppkey", "l_extendedprice"],
                       out, os.path.join(root, "_checkpoint"), files_per_trigger=4)
    return twin.read_upserted(spark, out, schema).select(*_FEED_COLS)


# ============================================================ dates and cells
_AT = "(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '13 hours 45 minutes 7.25 seconds')"


@register("mixed_dates", f"""
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 3, 4) THEN date_trunc('day', {_AT})
       WHEN o_orderkey % 11 = 5 THEN date_trunc('second', {_AT}) WHEN o_orderkey % 11 = 6 THEN {_AT}
       WHEN o_orderkey % 11 = 7 THEN date_trunc('minute', {_AT}) END AS data
FROM orders""")
def q_mixed_dates(t: Tables) -> DataFrame:
    """eight shapes of dates and three texts that are none."""
    return V.date_texts(t).select("order_key", E.parse_day_first("texto").cast("timestamp_ntz").alias("data"))


@register("date_rejects", W("sales_raw") + """
SELECT 'texto' AS coluna, count(*) AS linhas, count_if(o_orderkey % 11 = 10) AS vazias, count_if(o_orderkey % 11 IN (8, 9)) AS rejeitadas FROM orders
UNION ALL SELECT 'DT_NUM_NF', count(*), count_if(DT_NUM_NF IS NULL), 0 FROM sales_raw
UNION ALL SELECT 'GARANTIA', count(*), count_if(coalesce(trim(GARANTIA), '') = ''), count_if(coalesce(trim(GARANTIA), '') <> '') FROM sales_raw""")
def q_date_rejects(t: Tables) -> DataFrame:
    """texts that are no dates, counted per column."""
    return profile.date_rejects(V.date_texts(t), ["texto"]).unionByName(profile.date_rejects(_sales(t), ["DT_NUM_NF", "GARANTIA"]))


@register("serials_from_nested_pages", """
SELECT CAST(o_orderkey AS VARCHAR) AS page_key, unnest(CASE o_orderkey % 3
  WHEN 0 THEN [o_orderkey || '' || o_orderkey || 'a', o_orderkey || 'a', o_orderkey || 'b'] WHEN 1 THEN [CAST(o_orderkey AS VARCHAR)]
  ELSE ['S-' || o_orderkey || 'A'] END) AS serial FROM orders""")
def q_serials_from_nested_pages(t: Tables) -> DataFrame:
    """Tables in cells, very long rows, references and comments."""
    return pg.page_serials(V.nested_serial_pages(t)).select("page_key", F.explode("_serials").alias("serial"))


@register("report_rows", """
SELECT CAST(l_orderkey AS VARCHAR) AS page_key,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS pos,
       CAST(l_linenumber AS VARCHAR) AS tarefa, strftime(l_shipdate, '%d/%m/%Y') AS data, 'Cliente ' || l_suppkey || ' & Cia' AS cliente
FROM lineitem""")
def q_report_rows(t: Tables) -> DataFrame:
    """The rows between the header and the totals of every report page."""
    cells = F.col("cells")
    return pg.report_rows(V.report_pages(t)).select("page_key", "pos", cells[0].alias("tarefa"), cells[1].alias("data"), cells[2].alias("cliente"))


# ============================================================ silver tables
from fieldlens.plans import silver  # noqa: E402


@register("silver_date_filter", ORACLE["filter_dates"])
def q_silver_date_filter(t: Tables) -> DataFrame:
    """P4 on silver: years before the window are not read."""
    import datetime as dt
    return silver.between(silver.silver_of(t).tickets, dt.date(1997, 1, 1), dt.date(1998, 6, 30)).select("SS", "TAREFA")


@register("silver_search", ORACLE["search_any_column"])
def q_silver_search(t: Tables) -> DataFrame:
    """P5 on silver: blocks without the term's trigrams are not read."""
    s = silver.silver_of(t)
    return silver.search(s.tickets, s.index, SEARCH_TERM, SEARCH_COLUMNS).select("SS", "TAREFA")


@register("silver_search_serial", W("tickets_base") + f"SELECT SS, TAREFA FROM tickets_base WHERE {_search_sql('1234')}")
def q_silver_search_serial(t: Tables) -> DataFrame:
    """P5 on silver for part of a number."""
    s = silver.silver_of(t)
    return silver.search(s.tickets, s.index, "1234", SEARCH_COLUMNS).select("SS", "TAREFA")


@register("silver_installed_base_filter", ORACLE["installed_base_filter_third_party"])
def q_silver_installed_base_filter(t: Tables) -> DataFrame:
    """P7 on silver: the year range is a partition filter."""
    s = silver.silver_of(t)
    kept = filters.installed_base_filter(s.units, s.tickets, rtm="SIM", startup=E.dims.STARTUP_THIRD_PARTY, years=(1996, 2000), calls=(0, 40))
    return kept.select(F.col("ORDER_KEY").alias("order_key"), F.col("NUM_SERIAL").alias("num_serial"))


@register("silver_ticket_kpis", ORACLE["ticket_kpis"])
def q_silver_ticket_kpis(t: Tables) -> DataFrame:
    s = silver.silver_of(t)
    return kpi.ticket_unit_kpis(s.tickets, s.units)


@register("silver_rtm_analysis", ORACLE["rtm_analysis_by_year"])
def q_silver_rtm_analysis(t: Tables) -> DataFrame:
    s = silver.silver_of(t)
    return kpi.rtm_analysis_by_year(s.units, s.tickets, _errors(t), "SIM", V.AS_OF)


# ============================================================ remaining inventory items
@register("year_from_text", W("sales_raw") + """
SELECT TRY_CAST(nullif(regexp_extract(DT_NUM_NF, '(\\d{4})', 1), '') AS INTEGER) AS ano, count(*) AS n
FROM sales_raw GROUP BY 1""")
def q_year_from_text(t: Tables) -> DataFrame:
    """invoice year from the first four-digit run of the raw date text."""
    return _sales(t).groupBy(E.year_from_text("DT_NUM_NF").alias("ano")).agg(F.count(F.lit(1)).alias("n"))


@register("rtm_fill_before_year", W("sales") + """
SELECT CASE WHEN (RTM IS NULL OR trim(RTM) = '') AND ANO < 1998 THEN 'NAO' ELSE RTM END AS rtm, count(*) AS n
FROM sales GROUP BY 1""")
def q_rtm_fill_before_year(t: Tables) -> DataFrame:
    """blank RTM on lines invoiced before the target year becomes 'NAO'."""
    s = sales.sales_silver(_sales(t))
    return s.groupBy(E.fill_rtm_before_year("RTM", "ANO", 1998).alias("rtm")).agg(F.count(F.lit(1)).alias("n"))


@register("state_names", W("units") + """,
c AS (SELECT UF, count(*) AS n FROM units WHERE UF IS NOT NULL GROUP BY UF)
SELECT c.UF AS uf, n_name || ' / ' || r_name AS nome, c.n AS quantidade
FROM c LEFT JOIN nation ON c.UF = n_name LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_state_names(t: Tables) -> DataFrame:
    """State code -> display name through a lookup join.  The state
    dimension comes from ``nation`` x ``region``, a fixed 25-row table, so
    it is broadcast."""
    dim = (t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey)
           .select(F.col("n_name").alias("_uf"), F.concat("n_name", F.lit(" / "), "r_name").alias("nome")))
    c = _units(t).where(F.col("UF").isNotNull()).groupBy("UF").agg(F.count(F.lit(1)).alias("quantidade"))
    j = c.join(F.broadcast(dim), c.UF == dim._uf, "left")
    return j.select(F.col("UF").alias("uf"), "nome", "quantidade")


register("warranty_sales_1998", _a17_sql("dispenser_w7", "legacy").replace(
    "WHERE s.DT IS NOT NULL", "WHERE s.DT IS NOT NULL AND s.ANO IN (1998)"))(
    lambda t: sales.warranty_sales_by_year(_sales(t), V.item_warranty(t), V.item_rtm(t), V.AS_OF,
                                           "dispenser_w7", "legacy", years=[1998]))


@register("model_bars", W("units_all") + ", s AS (SELECT " + ", ".join(
    [f"{P(f'count_if(MODELO = {chr(39)}{m}{chr(39)})', 'count(*)')} AS pct_{m.lower()}" for m in E.dims.MAIN_MODELS]
    + [f"{P('count_if(MODELO IS NOT NULL AND MODELO NOT IN (' + ', '.join(repr(m) for m in E.dims.MAIN_MODELS) + '))', 'count(*)')} AS pct_others"])
    + " FROM units_all WHERE trim(PAIS) = 'BR')\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m.lower()}' AS modelo, pct_{m.lower()} AS pct FROM s" for m in E.dims.MAIN_MODELS + ["others"])
    + ") WHERE pct > 0")
def q_model_bars(t: Tables) -> DataFrame:
    """Model shares above zero as rows (others last when displayed)."""
    return charts.model_bars(kpi.model_share(_units(t, drop_other_models=False)))


_REPORT_YEAR = 1998


@register("domestic_units_report", W("units") + f""",
y AS (SELECT * FROM units WHERE ANO_NF = {_REPORT_YEAR})
SELECT 'rtm' AS secao, RTM AS chave, count(*) AS n FROM y GROUP BY 2
UNION ALL SELECT 'modelo', MODELO, count(*) FROM y GROUP BY 2
UNION ALL SELECT 'periodo', CAST(GARANTIA AS VARCHAR), count(*) FROM y GROUP BY 2
UNION ALL SELECT 'garantia_eletronica', CASE WHEN coalesce(DT_NUM_NF + 365 >= {O.AS_OF_SQL}, false) THEN 'DENTRO' ELSE 'FORA' END,
                 count(*) FROM y GROUP BY 2""")
def q_domestic_units_report(t: Tables) -> DataFrame:
    """One year of domestic units by RTM class, model, warranty period
    and electronic-warranty status, in one pass (long format)."""
    y = _units(t).where(F.col("ANO_NF") == _REPORT_YEAR)
    sections = F.array(
        F.struct(F.lit("rtm").alias("secao"), F.col("RTM").alias("chave")),
        F.struct(F.lit("modelo").alias("secao"), F.col("MODELO").alias("chave")),
        F.struct(F.lit("periodo").alias("secao"), F.col("GARANTIA").cast("string").alias("chave")),
        F.struct(F.lit("garantia_eletronica").alias("secao"),
                 E.electronic_warranty_status("DT_NUM_NF", V.AS_OF).alias("chave")))
    return (y.select(F.explode(sections).alias("r")).select("r.*").groupBy("secao", "chave")
            .agg(F.count(F.lit(1)).alias("n")))


@register("enrich_warranty", W("sales", "item_warranty", "item_pages") + f""",
todo AS (SELECT DISTINCT ITEM FROM sales WHERE ANO >= {_ENRICH_YEAR} AND (GARANTIA IS NULL OR trim(GARANTIA) = '')
         AND ITEM IS NOT NULL AND ITEM NOT IN (SELECT ITEM FROM item_warranty WHERE ITEM IS NOT NULL)),
x AS (SELECT todo.ITEM, {O.warranty_sentence('p.html')} AS txt FROM todo JOIN item_pages p ON todo.ITEM = p.page_key)
SELECT ITEM, coalesce(CAST({O.warranty_days('txt')} AS VARCHAR), txt) AS GARANTIA FROM x""")
def q_enrich_warranty(t: Tables) -> DataFrame:
    return jobs.enrich_warranty_cache(_sales(t), V.item_warranty(t), V.item_pages(t), _ENRICH_YEAR)


@register("enrich_rtm", W("sales", "item_rtm", "item_pages") + f""",
s2 AS (SELECT ITEM, ANO, CASE WHEN (RTM IS NULL OR trim(RTM) = '') AND ANO < {_ENRICH_YEAR} THEN 'NAO' ELSE RTM END AS RTM FROM sales),
todo AS (SELECT DISTINCT ITEM FROM s2 WHERE ANO >= {_ENRICH_YEAR} AND (RTM IS NULL OR trim(RTM) = '')
         AND ITEM IS NOT NULL AND ITEM NOT IN (SELECT ITEM FROM item_rtm WHERE ITEM IS NOT NULL))
SELECT todo.ITEM, CASE WHEN coalesce(regexp_matches(upper(p.html), 'BLUETOOTH|BLUETOOH'), false) THEN 'SIM' ELSE 'NAO' END AS RTM
FROM todo JOIN item_pages p ON todo.ITEM = p.page_key""")
def q_enrich_rtm(t: Tables) -> DataFrame:
    return jobs.enrich_rtm_cache(_sales(t), V.item_rtm(t), V.item_pages(t), _ENRICH_YEAR)
