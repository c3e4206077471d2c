"""Dedup (G-1), lookups (G-2) and page parsing (G-11)."""

import datetime as dt

from pyspark.sql import functions as F

from fieldlens.operators import dedup, joins
from fieldlens.sources import pages


def test_g1_latest_per_key(spark):
    d = dt.datetime
    df = spark.createDataFrame([
        ("1", "1", d(2025, 1, 1), 5, "old"), ("1", "1", d(2025, 2, 1), 1, "new"),
        ("2", "1", d(2025, 1, 1), 1, "tie-low"), ("2", "1", d(2025, 1, 1), 9, "tie-high"),
        ("3", "1", None, 1, "null-date"), ("3", "1", d(2024, 1, 1), 1, "dated"),
    ], "SS string, Tarefa string, Data timestamp_ntz, tie int, payload string")
    out = {r["SS"]: r["payload"] for r in dedup.latest_per_key(df, ["SS", "Tarefa"], [F.col("Data"), F.col("tie")]).collect()}
    assert out == {"1": "new", "2": "tie-high", "3": "dated"}
    first = {r["SS"]: r["payload"] for r in dedup.first_per_key(df, ["SS"], [F.col("Data"), F.col("tie")]).collect()}
    assert first == {"1": "old", "2": "tie-low", "3": "dated"}


def test_g2_lookup(spark):
    df = spark.createDataFrame([("a",), ("zzz",), (None,)], "M string")
    dim = spark.createDataFrame([("a", "A1"), ("a", "A2")], "raw string, label string")
    out = [r["M"] for r in joins.lookup(df, "M", dim, "M").collect()]
    assert sorted(out) == ["", "", "A2"]


def test_g11_pages(spark):
    html_serials = ('<table><tr><td>decoy</td></tr><tr><td>no</td></tr></table>'
                    '<table border="1"><tr><th>Serial</th></tr><tr><td> S1 </td><td>x</td></tr>'
                    '<tr><td>S2</td></tr><tr><td> </td></tr><tr><td> S3 <b> x </b></td></tr></table>')
    p = spark.createDataFrame([("L1", html_serials), ("L2", '<table border=1><tr><th>Serial</th></tr></table>'),
                               ("L3", "<p>none</p>")], "page_key string, html string")
    lines = spark.createDataFrame([("L1",), ("L2",), ("L3",), ("L4",)], "k string")
    out = sorted((r["k"], r["Serial"]) for r in pages.unpack_serials(lines, p, "k").collect())
    assert out == [("L1", "S1"), ("L1", "S2"), ("L1", "S3x"), ("L2", ""), ("L3", "")]

    q = spark.createDataFrame([
        ("i1", "<td>Modelo</td><td>Garantia: <b>36 MESES</b></td><p>BLUETOOTH</p>"),
        ("i2", "<td>WARRANTY 12 months</td> bluetooh"),
        ("i3", "<td>Prazo</td>")], "page_key string, html string")
    r = {x["page_key"]: (x["RTM"], x["GARANTIA_TEXTO"]) for x in pages.page_flags(q, "page_key").collect()}
    assert r == {"i1": ("SIM", "Garantia: 36 MESES"), "i2": ("SIM", "WARRANTY 12 months"), "i3": ("NAO", "NAO ENCONTRADO")}


def test_report_rows_drop_header_and_totals(spark):
    html = ("<table><tr><th>SS</th><th>Status</th></tr><tr><td>1</td><td>ABERTO</td></tr>"
            "<tr><td>2</td><td>FECHADO</td></tr><tr><td>Total</td><td>2</td></tr></table>")
    out = pages.report_rows(spark.createDataFrame([("m1", html)], "page_key string, html string")).collect()
    assert [r["cells"] for r in sorted(out, key=lambda r: r["pos"])] == [["1", "ABERTO"], ["2", "FECHADO"]]


def test_serials_in_page_edge_cases(spark):
    cases = [
        ('<table border="1"><tr><th>S</th></tr><tr><td> A </td><td>x</td></tr><tr><th>n</th></tr>'
         '<tr><td>B <b> c </b></td></tr><tr><td> </td></tr></table>', ["A", "Bc"]),
        ("<table border=1><tr><td>H</td></tr><tr><td>A</td>", []),          # unclosed last row
        ("<table border=1><tr><td>H</td></tr></table>", []),                  # header only
        ("<p/>", []),
        ('<TABLE BORDER="1"><TR><TD>h</TD></TR><TR><TD>Z</TD></TR></TABLE>', ["Z"]),
        ('<table><tr><td>x</td></tr><tr><td>y</td></tr></table>', []),       # no border=1 table
    ]
    df = spark.createDataFrame([(h,) for h, _ in cases], "html string")
    got = [r[0] for r in df.select(pages.serials_in_page(F.col("html"))).collect()]
    assert got == [want for _, want in cases]
