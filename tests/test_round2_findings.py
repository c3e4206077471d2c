"""Inputs that the driver tables do not hold: odd blanks, repeated lookups, other column orders, hot items."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fieldlens.functions import expr as E
from fieldlens.operators import filters, joins, sales
from fieldlens.plans import jobs
from fieldlens.sources import files, pages

AS_OF = dt.date(2025, 6, 1)


def values(spark, col, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(col).collect()]


def test_white_space_of_every_kind_is_stripped(spark):
    assert values(spark, E.clean_serial("c"), "123\r", "\t12.0\n", "\xa0", "1 2") == ["123", "12", "N/A", "1 2"]
    assert values(spark, E.decimal_comma_number("c"), " 1,5\r\n") == [1.5]


def test_too_large_numbers_do_not_fail_the_job(spark):
    assert values(spark, E.spreadsheet_date_text("c"), "45000", "99999999999") == ["15/03/2023", "99999999999"]
    assert values(spark, E.warranty_text_to_days("c", "legacy"), "123456789 M", "123456789 ANOS")[0] is not None
    values(spark, E.warranty_text_to_days("c"), "123456789 M", "99999999999")


def test_search_ignores_the_case_of_accents(spark):
    df = spark.createDataFrame([("NÃO INFORMADO",), ("sim",)], "c string")
    assert filters.search_any_column(df, "não").count() == 1


def lines(spark, n=30):
    rows = [(str(k), "1", "HOT" if k % 3 == 0 else f"W7-{k}", "BOMBA MEDIDORA", "DISPENSERS", "A", "2,0", "01/02/2025",
             "", "") for k in range(n)]
    return spark.createDataFrame(rows, "PEDIDO string, LINHA string, ITEM string, DESCRICAO string, SEGMENTO string, TIPO string, "
                                       "QUANTIDADE string, DT_NUM_NF string, GARANTIA string, RTM string")


def test_the_last_cached_value_wins(spark):
    cache = spark.createDataFrame([("HOT", "NAO ENCONTRADO", 1), ("HOT", "730", 2), ("HOT", None, 3)], "ITEM string, GARANTIA string, ORDEM int")
    rtm = spark.createDataFrame([("HOT", "SIM", 2), ("HOT", "NAO", 1)], "ITEM string, RTM string, ORDEM int")
    got = {r.is_rtm: r for r in sales.units_inline_fill(lines(spark), cache, rtm, AS_OF).collect()}
    assert got[True].linhas == got[True].garantia_ativa == 10 and got[False].garantia_ativa == 0
    names = joins.lookup(spark.createDataFrame([("a",)], "x string"), "x",
                         spark.createDataFrame([("a", "z", 1), ("a", "b", 2)], "raw string, label string, p int"), "y", order="p")
    assert names.first().y == "b"


def test_lines_are_summed_before_the_join(spark):
    rtm = spark.createDataFrame([("HOT", "SIM")], "ITEM string, RTM string")
    plan = sales.rtm_split(lines(spark), rtm)._jdf.queryExecution().optimizedPlan().toString()
    join, aggregate = plan.index("Join"), plan.rindex("Aggregate [ITEM")
    assert join < aggregate  # printed from the top: the aggregate lies below the join
    got = {r.categoria: r.quantidade for r in sales.rtm_split(lines(spark), rtm).collect()}
    assert got == {"RTM": 20.0, "NON_RTM": 40.0, "TOTAL": 60.0}


def test_years_of_any_date_text(spark):
    df = spark.createDataFrame([("A", "2024/05/01", ""), ("B", "x 2023", ""), ("C", "2025-01-01T10", "1")], "ITEM string, DT_NUM_NF string, GARANTIA string")
    assert [r.ITEM for r in sales.items_to_look_up(df, df.limit(0), 2024).collect()] == ["A"]


def test_serial_cells_with_blanks_and_references(spark):
    html = '<table border=1><tr><th>S</th></tr><tr><td>\n  123\n</td></tr><tr><td>&nbsp;</td></tr><tr><td>A&amp;B</td></tr></table>'
    assert values(spark, pages.serials_in_page(F.col("c")), html) == [["123", "A&B"]]


def test_repeated_lines_and_pages_do_not_multiply(spark):
    html = '<table border=1><tr><th>S</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>'
    left = spark.createDataFrame([("k", "a")] * 500 + [("j", "b")], "key string, x string")
    page = spark.createDataFrame([("k", html, 2), ("k", "<p>old</p>", 1), ("j", html, 1)] * 3, "page_key string, html string, at int")
    got = sorted(map(tuple, pages.unpack_serials(left, page, "key", fetched="at").collect()))
    assert got == [("j", "b", "1"), ("j", "b", "2"), ("k", "a", "1"), ("k", "a", "2")]


def test_columns_are_bound_by_header(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "f.csv")
    with open(path, "w") as f:
        f.write("B;A\n1;x\ny;z\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("A", T.StringType()), T.StructField("B", T.IntegerType()), T.StructField("C", T.StringType())])
    assert sorted(map(tuple, files.read_delimited(spark, path, schema).collect()), key=str) == [("x", 1, None), ("z", None, None)]


def test_the_last_file_wins(spark, tmpdir_path):
    for name, value in (("a.csv", "old"), ("b.csv", "new")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(f"ITEM;GARANTIA\nX;{value}\n")
    df = files.in_file_order(spark.read.option("header", True).option("sep", ";").csv(tmpdir_path))
    assert files.load_lookup(df, order="ORDEM").first().GARANTIA == "new"


def test_lines_are_filled_from_the_cache(spark):
    cache = spark.createDataFrame([("HOT", "365")], "ITEM string, GARANTIA string")
    out = jobs.fill_lines(lines(spark), cache, "GARANTIA", "NAO ENCONTRADO")
    assert out.count() == 30 and out.where("GARANTIA = '365'").count() == 10 and out.where("GARANTIA = 'NAO ENCONTRADO'").count() == 20


def test_relationship_inputs(spark):
    from fieldlens.operators import relationship as rel

    rows = [("M", "1", dt.datetime(2025, 1, 1), 4.0), ("M", "1", dt.datetime(2025, 1, 2), 6.0), ("N", "2", dt.datetime(2025, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "MANTENEDOR string, CHAMADO string, INICIO timestamp_ntz, AGING double")
    prepared = rel.prepare_source(df, AS_OF)
    got = {r.MANTENEDOR: (r.VOLUME, r.AGING_MEDIO_DIAS) for r in rel.matrix(prepared).collect()}
    assert got == {"M": (1, 5.0), "N": (1, 1.0)}  # two rows of one CHAMADO are one ticket
    again = rel.prepare_source(prepared, AS_OF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, prepared.collect()))
    assert rel.prepare_source(df.drop("AGING"), AS_OF).count() == 0  # no aging without FIM
