"""DuckDB SQL for the derived views and every registered query.

This is an independent second implementation used as the correctness
oracle: plain SQL with window functions and IN-subqueries, where the Spark
side uses grouped struct-min dedups and flag joins.  Views are CTEs over
the pre-registered driver tables.
"""

from __future__ import annotations

from fieldlens.functions import dims
from fieldlens.sources import views as V

AS_OF_SQL = f"DATE '{V.AS_OF.isoformat()}'"
AS_OF_TS_SQL = f"TIMESTAMP '{V.AS_OF.isoformat()} 00:00:00'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def model_case(prefix_sql: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.MODEL_MAPPING.items())
    return f"(CASE {prefix_sql} {whens} ELSE 'OUTROS' END)"


def item_prefix(col: str) -> str:
    return f"upper(trim(split_part(coalesce(CAST({col} AS VARCHAR), ''), '-', 1)))"


def clean_serial(col: str) -> str:
    s = f"regexp_replace(trim(coalesce({col}, '')), '\\.0$', '')"
    return f"(CASE WHEN {s} = '' THEN 'N/A' ELSE {s} END)"


def tags(col: str) -> str:
    raw = f"regexp_extract_all(coalesce({col}, ''), '\\[(.*?)\\]', 1)"
    t = f"list_sort(list_distinct(list_filter(list_transform({raw}, lambda x: upper(trim(x))), lambda x: x <> '')))"
    return f"(CASE WHEN len({t}) = 0 THEN ['{dims.NO_TAGS}'] ELSE {t} END)"


def pct(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN 100.0::DOUBLE * ({num}) / ({den}) ELSE 0.0::DOUBLE END)"


CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = sql
    DEPS[name] = deps or []


cte("ticket_feed", """
SELECT CAST(l_orderkey AS VARCHAR) AS SS, CAST(l_linenumber AS VARCHAR) AS TAREFA,
       l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate AS DATA,
       CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS RESOLVIDO,
       CASE WHEN l_linestatus = 'O' THEN 'ABERTO' ELSE 'FECHADO' END AS STATUS,
       CASE l_returnflag WHEN 'A' THEN 'WBP EQUIPAMENTO DOMESTICO' WHEN 'R' THEN 'Wbp Equipamento Exportacao' ELSE l_returnflag END AS TIPO,
       CASE l_partkey % 3 WHEN 0 THEN 'Com RTM' WHEN 1 THEN 'rtm-bt' ELSE 'MECANICA' END AS RTM_RAW
FROM lineitem""")

cte("raw_tickets", """
SELECT f.SS, f.TAREFA,
       CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0' ELSE CAST(o_custkey AS VARCHAR) END AS CHASSI,
       f.DATA, f.RESOLVIDO, f.STATUS, o_orderstatus AS PROPRIETARIO, s_name AS MANTENEDOR,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'PARTIDA INICIAL' ELSE o_orderpriority END AS SERVICO,
       f.TIPO,
       CASE WHEN p_size % 10 = 5 THEN p_name
            ELSE (CASE WHEN p_size % 10 = 0 THEN '[stb] ' ELSE '' END) || '[' || p_type || '] [' || lower(p_brand) || '] ' || p_name
       END AS SUMARIO,
       f.RTM_RAW AS RTM, f.l_partkey, f.l_suppkey, f.l_extendedprice
FROM ticket_feed f JOIN orders ON f.l_orderkey = o_orderkey
     JOIN supplier ON f.l_suppkey = s_suppkey JOIN part ON f.l_partkey = p_partkey""", ["ticket_feed"])

cte("tickets_dedup", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY SS, TAREFA
         ORDER BY DATA DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM raw_tickets) WHERE rn = 1""", ["raw_tickets"])

cte("maint_dim", """
SELECT s_name AS raw, max('SAW-' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS label
FROM supplier WHERE s_suppkey % 10 <> 9 GROUP BY s_name""")
cte("spec_dim", """
SELECT s_name AS raw, max('ESP-' || CAST(s_suppkey % 7 AS VARCHAR)) AS label
FROM supplier WHERE s_suppkey % 10 <> 8 GROUP BY s_name""")
cte("owner_dim", "SELECT * FROM (VALUES ('O', 'OWNER OPEN'), ('F', 'OWNER FINAL')) v(raw, label)")

_FIM = f"(CASE WHEN d.RESOLVIDO IS NULL AND d.STATUS = 'ABERTO' THEN {AS_OF_TS_SQL} ELSE d.RESOLVIDO END)"
cte("tickets_base", f"""
SELECT d.SS, d.TAREFA, {clean_serial('d.CHASSI')} AS CHASSI, d.DATA, d.RESOLVIDO, d.STATUS,
       coalesce(od.label, '') AS PROPRIETARIO, coalesce(md.label, '') AS MANTENEDOR,
       coalesce(sd.label, '') AS ESPECIALISTA, d.SERVICO, d.TIPO, d.SUMARIO,
       CASE WHEN coalesce(contains(upper(d.RTM), 'RTM'), false) THEN 'SIM' ELSE 'NÃO' END AS RTM,
       d.DATA AS INICIO, {_FIM} AS FIM,
       CAST(floor(date_diff('second', d.DATA, {_FIM}) / 86400) AS INTEGER) AS AGING,
       {tags('d.SUMARIO')} AS TAGS
FROM tickets_dedup d LEFT JOIN maint_dim md ON d.MANTENEDOR = md.raw
     LEFT JOIN spec_dim sd ON d.MANTENEDOR = sd.raw LEFT JOIN owner_dim od ON d.PROPRIETARIO = od.raw""",
    ["tickets_dedup", "maint_dim", "spec_dim", "owner_dim"])

_COUNTRY = "CASE WHEN r_name = 'AMERICA' THEN 'BR' ELSE upper(substr(r_name, 1, 2)) END"
cte("raw_units", f"""
SELECT CAST(o_custkey AS VARCHAR) AS NUM_SERIAL,
       {_list(V.UNIT_PREFIXES)}[c_custkey % 7 + 1] || '-' || CAST(o_orderkey AS VARCHAR) AS ITEM,
       CAST(o_orderdate AS DATE) AS DT_NUM_NF,
       CASE o_orderkey % 6 WHEN 0 THEN '183' WHEN 1 THEN '365' WHEN 2 THEN '548' WHEN 3 THEN '730'
            WHEN 4 THEN '1095' ELSE '' END AS GARANTIA,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SIM' ELSE 'NAO' END AS RTM,
       n_name AS UF, {_COUNTRY} AS PAIS, c_name AS CLIENTE, c_mktsegment AS SEGMENTO,
       'Rua ' || CAST(c_custkey AS VARCHAR) || ', Cidade, ' || chr(CAST(n_nationkey + 65 AS INTEGER))
         || chr(CAST(n_regionkey + 65 AS INTEGER)) || ', ' || {_COUNTRY} AS ENDERECO,
       o_orderkey AS ORDER_KEY
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey""")

cte("units_all", f"""
SELECT *, year(DT_NUM_NF) AS ANO_NF, DT_NUM_NF + GARANTIA AS FIM_GARANTIA,
       CASE WHEN DT_NUM_NF + GARANTIA IS NULL THEN '' WHEN DT_NUM_NF + GARANTIA >= {AS_OF_SQL} THEN 'DENTRO'
            ELSE 'FORA' END AS STATUS_GARANTIA,
       {model_case(item_prefix('ITEM'))} AS MODELO
FROM (SELECT * REPLACE (CAST(trunc(coalesce(TRY_CAST(GARANTIA AS DOUBLE), 0)) AS INTEGER) AS GARANTIA) FROM raw_units)""",
    ["raw_units"])
cte("units", "SELECT * FROM units_all WHERE trim(PAIS) = 'BR' AND MODELO <> 'OUTROS'", ["units_all"])

cte("unit_first", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY NUM_SERIAL
       ORDER BY DT_NUM_NF NULLS LAST, ORDER_KEY) AS rn FROM units WHERE NUM_SERIAL IS NOT NULL) WHERE rn = 1""",
    ["units"])
cte("tickets", """
SELECT t.*, u.MODELO, u.STATUS_GARANTIA AS GARANTIA
FROM tickets_base t LEFT JOIN unit_first u ON t.CHASSI = u.NUM_SERIAL""", ["tickets_base", "unit_first"])

cte("errors", """
SELECT DISTINCT upper(trim(SS)) AS SS, upper(trim(TIPO_ERRO)) AS TIPO_ERRO, upper(trim(DESC_ERRO)) AS DESC_ERRO,
       upper(trim(COD_ERRO)) AS COD_ERRO, upper(trim(DETALHES_ERRO)) AS DETALHES_ERRO, VALOR_PECA, VALOR_TOTAL
FROM (SELECT CAST(event_id AS VARCHAR) AS SS, 'TIPO ' || CAST(user_id % 5 AS VARCHAR) AS TIPO_ERRO,
             props AS DESC_ERRO, 'E' || lpad(CAST(user_id % 17 AS VARCHAR), 3, '0') AS COD_ERRO,
             CASE WHEN value >= 250 THEN 'ALTO' ELSE 'BAIXO' END AS DETALHES_ERRO,
             value / 4 AS VALOR_PECA, value AS VALOR_TOTAL
      FROM events WHERE event_type = 'error')""")

# serial sets used by the installed-base analyses
cte("startup_set", """SELECT DISTINCT CHASSI FROM tickets_base
WHERE coalesce(contains(SERVICO, 'PARTIDA INICIAL'), false) AND CHASSI IS NOT NULL""", ["tickets_base"])
cte("call_set", """SELECT DISTINCT CHASSI FROM tickets_base
WHERE NOT coalesce(regexp_matches(SUMARIO, '\\[STB\\]', 'i'), false)
  AND NOT coalesce(contains(SERVICO, 'PARTIDA INICIAL'), false) AND CHASSI IS NOT NULL""", ["tickets_base"])
cte("error_set", """SELECT DISTINCT CHASSI FROM tickets_base
WHERE trim(SS) IN (SELECT trim(SS) FROM errors WHERE SS IS NOT NULL) AND CHASSI IS NOT NULL""",
    ["tickets_base", "errors"])
cte("valid_counts", """SELECT CHASSI, count(*) AS n FROM tickets_base
WHERE NOT coalesce(regexp_matches(SUMARIO, '\\[STB\\]', 'i'), false) AND CHASSI IS NOT NULL GROUP BY CHASSI""",
    ["tickets_base"])


def with_views(*names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"


# ------------------------------------------------------------- sales views
cte("sales_raw", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS PEDIDO, CAST(l_linenumber AS VARCHAR) AS LINHA,
       {_list(V.SALES_PREFIXES)}[l_partkey % 8 + 1] || '-' || CAST(l_partkey AS VARCHAR) AS ITEM,
       CASE WHEN p_size % 4 = 0 THEN 'BOMBA MEDIDORA DE COMBUSTIVEIS LIQUIDOS - ' || upper(p_brand) || ' - ' || upper(p_name)
            WHEN p_size % 4 = 1 THEN 'BOMBA ' || upper(p_name)
            WHEN p_size % 4 = 2 THEN 'SERVICO DE MANUTENCAO ' || upper(p_name) ELSE upper(p_name) END AS DESCRICAO,
       CASE WHEN p_size <= 20 THEN 'DISPENSERS' WHEN p_size <= 35 THEN 'PECAS' ELSE 'SERVICOS' END AS SEGMENTO,
       CASE l_returnflag WHEN 'A' THEN 'WBP EQUIPAMENTO DOMESTICO' WHEN 'R' THEN 'Wbp Equipamento Exportacao' ELSE l_returnflag END AS TIPO,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',0'
            ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS QUANTIDADE,
       CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d/%m/%Y') END AS DT_NUM_NF,
       strftime(o_orderdate, '%d/%m/%Y') AS DATA_CRIACAO,
       strftime(o_orderdate + INTERVAL 3 DAY, '%d/%m/%Y') AS DATA_BOOKED,
       CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'NAO ENCONTRADO'
            ELSE CAST((l_orderkey % 3 + 1) * 365 AS VARCHAR) END AS GARANTIA,
       CASE WHEN l_linenumber % 4 = 0 THEN 'SIM' WHEN l_linenumber % 4 = 1 THEN 'NAO' ELSE '' END AS RTM
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""")


def parse_date(col: str) -> str:
    s = f"trim(CAST({col} AS VARCHAR))"
    return f"CAST(coalesce(try_strptime({s}, '%d/%m/%Y'), try_strptime({s}, '%Y-%m-%d')) AS DATE)"


def decimal_comma(col: str) -> str:
    return f"coalesce(TRY_CAST(replace(trim(CAST({col} AS VARCHAR)), ',', '.') AS DOUBLE), 0.0)"


cte("sales", f"""
SELECT *, {decimal_comma('QUANTIDADE')} AS QTD, {parse_date('DT_NUM_NF')} AS DT,
       CAST(year({parse_date('DT_NUM_NF')}) AS INTEGER) AS ANO FROM sales_raw""", ["sales_raw"])

_ITEM = f"{_list(V.SALES_PREFIXES)}[p_partkey % 8 + 1] || '-' || CAST(p_partkey AS VARCHAR)"
cte("item_warranty", f"""
SELECT {_ITEM} AS ITEM,
       CASE p_size % 8 WHEN 0 THEN 'GARANTIA: 36 MESES' WHEN 1 THEN '12 MONTHS' WHEN 2 THEN '730' WHEN 3 THEN NULL
            WHEN 4 THEN '2 ANOS' WHEN 5 THEN 'NAO ENCONTRADO' WHEN 6 THEN 'Warranty - 18 meses' ELSE '30 MESES' END AS GARANTIA
FROM part WHERE p_partkey % 10 <> 0""")
cte("item_rtm", f"""
SELECT {_ITEM} AS ITEM, CASE WHEN p_partkey % 3 = 0 THEN 'SIM' ELSE 'NAO' END AS RTM
FROM part WHERE p_partkey % 10 <> 1""")


def _strip(col: str) -> str:
    s = f"trim(upper(CAST({col} AS VARCHAR)))"
    for p in dims.WARRANTY_TEXT_PREFIXES:
        s = f"trim(replace({s}, '{p}', ''))"
    return s


def warranty_days(col: str, mode: str = "canonical") -> str:
    """F18/F19 in SQL (see ``fieldlens.functions.expr.warranty_text_to_days``)."""
    s = _strip(col)
    raw = f"CAST({col} AS VARCHAR)"
    blank = f"({col} IS NULL OR trim({raw}) = '' OR upper(trim({raw})) = '{dims.NOT_FOUND}')"
    months = f"TRY_CAST(nullif(regexp_extract({s}, '(\\d+)\\s*(MES|MONTH|M)', 1), '') AS INTEGER)"
    years = f"TRY_CAST(nullif(regexp_extract({s}, '(\\d+)\\s*(ANO|YEAR|Y)', 1), '') AS INTEGER)"
    numeric = f"TRY_CAST(replace(trim({raw}), ',', '.') AS DOUBLE)"
    num_int = f"TRY_CAST(trunc({numeric}) AS INTEGER)"
    if mode == "numeric":
        return f"coalesce({num_int}, 0)"
    items = list(dims.WARRANTY_TEXT_TO_DAYS.items())
    if mode == "legacy":
        pat = "CASE " + " ".join(f"WHEN contains({s}, '{p}') THEN {d}" for p, d in items) + " END"
        return (f"(CASE WHEN {blank} THEN 0 ELSE coalesce({num_int}, {pat}, CAST(floor({months} * 30.44) AS INTEGER), "
                f"{years} * 365, 0) END)")
    items = sorted(items, key=lambda kv: len(kv[0]), reverse=True)
    pat = "CASE " + " ".join(f"WHEN regexp_matches({s}, '(^|\\D){p}') THEN {d}" for p, d in items) + " END"
    md = f"floor({months} * 30.44)"
    snapped = (f"CASE WHEN {md} <= 183 THEN 183 WHEN {md} <= 365 THEN 365 WHEN {md} <= 548 THEN 548 "
               f"WHEN {md} <= 730 THEN 730 ELSE 1095 END")
    by_years = f"CASE {years} WHEN 1 THEN 365 WHEN 2 THEN 730 WHEN 3 THEN 1095 END"
    return (f"(CASE WHEN {blank} THEN NULL ELSE CAST(coalesce({num_int}, {pat}, CASE WHEN {months} IS NOT NULL THEN {snapped} END, "
            f"{by_years}) AS INTEGER) END)")


def product(variant: str) -> str:
    seg = "coalesce(contains(upper(SEGMENTO), 'DISPENSER'), false)"
    w7 = "coalesce(starts_with(upper(ITEM), 'W7'), false)"
    bomba = "coalesce(contains(upper(DESCRICAO), 'BOMBA'), false)"
    med = "coalesce(contains(upper(DESCRICAO), 'BOMBA MEDIDORA'), false)"
    tipo = "coalesce(upper(TIPO) IN ('WBP EQUIPAMENTO DOMESTICO', 'WBP EQUIPAMENTO EXPORTACAO'), false)"
    return {"dispenser_w7": f"({seg} AND {w7})", "w7": w7, "bomba": bomba, "bomba_medidora": med,
            "segment": seg, "w7_bomba": f"({w7} AND {bomba})", "w7_bomba_medidora": f"({w7} AND {med})",
            "tipo": tipo, "tipo_bomba_medidora": f"({tipo} AND {med})", "linha_1_2": "LINHA IN ('1', '2')",
            "all": "true"}[variant]


# ------------------------------------------------------------- page views
cte("serial_pages", """
SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS page_key,
       CASE WHEN l_linenumber % 5 = 4 THEN '<p>sem tabela</p>'
            ELSE '<table><tr><td>x</td></tr><tr><td>decoy</td></tr></table><table border="1"><tr><th>Serial</th><th>Obs</th></tr>'
                 || array_to_string(list_transform(generate_series(1, l_linenumber % 3),
                      lambda i: '<tr><td> ' || CAST(l_orderkey * 10 + i AS VARCHAR) || ' </td><td>ok</td></tr>'), '')
                 || '</table>' END AS html
FROM lineitem""")
cte("item_pages", f"""
SELECT {_ITEM} AS page_key,
       '<html><body><table><tr><td>Descrição</td><td>' || p_name || '</td></tr><tr><td>'
       || CASE p_size % 5 WHEN 0 THEN 'Garantia: <b>36 MESES</b>' WHEN 1 THEN 'WARRANTY 12 months'
               WHEN 2 THEN 'Prazo: 24 meses' WHEN 3 THEN '  garantia de 2 anos' ELSE '' END
       || '</td></tr></table><p>'
       || CASE p_partkey % 4 WHEN 0 THEN 'Conectividade BLUETOOTH' WHEN 1 THEN 'modulo bluetooh' ELSE 'mecanica' END
       || '</p></body></html>' AS html
FROM part
UNION ALL
SELECT 'page-' || CAST(page_id AS VARCHAR) AS page_key, html FROM pages""")


def page_text(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace({col}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def warranty_sentence(html: str) -> str:
    cells = f"regexp_extract_all(coalesce({html}, ''), '(?is)<td[^>]*>(.*?)</td>', 1)"
    texts = f"list_transform({cells}, lambda t: {page_text('t')})"
    hits = f"list_filter({texts}, lambda t: starts_with(upper(t), 'GARANTIA') OR starts_with(upper(t), 'WARRANTY'))"
    return f"coalesce(({hits})[1], '{dims.NOT_FOUND}')"


def serials_in_page(html: str) -> str:
    table = f"""regexp_extract(coalesce({html}, ''), '(?is)<table[^>]*\\bborder\\s*=\\s*["'']?1\\b[^>]*>(.*?)</table>', 1)"""
    rows = f"regexp_extract_all({table}, '(?is)<tr[^>]*>(.*?)</tr>', 1)"
    cell = "trim(regexp_replace(regexp_extract(r, '(?is)<td[^>]*>(.*?)</td>', 1), '\\s*<[^>]*>\\s*', '', 'g'))"
    first = f"list_transform(({rows})[2:], lambda r: {cell})"
    return f"list_filter({first}, lambda s: s <> '')"
