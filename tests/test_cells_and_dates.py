"""Dates of all shapes (F4, F15), character references and nested cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import expr as E
from fieldlens.sources import pages


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("15-03-2023", (2023, 3, 15)), ("2024/05/01", (2024, 5, 1)), ("2024-05-01 10:30", (2024, 5, 1, 10, 30)), ("15.03.2023", (2023, 3, 15)),
    ("5/1/24", (2024, 1, 5)), ("5/1/69", (1969, 1, 5)), ("01/02/2023 10:11:12.5", (2023, 2, 1, 10, 11, 12, 500000)),
    ("2024-05-01T10:30:15.123456789Z", (2024, 5, 1, 10, 30, 15, 123456)), ("2024.5.1 1:02", (2024, 5, 1, 1, 2)),
    ("15-03-2023 23:59:59,25", (2023, 3, 15, 23, 59, 59, 250000)), ("15/03/2023", (2023, 3, 15)), ("\xa015/03/2023\t", (2023, 3, 15)),
    ("2023-03-15", (2023, 3, 15)), ("31/02/2023", None), ("31-02-2023", None), ("15-03/2023", None), ("15-13-2023", None),
    ("2024-05-01 25:00", None), ("2024-05-01 10:61", None), ("", None), ("x", None), (None, None), ("1234", None), ("5/1/245", None),
    ("2024-05", None), ("15/03/2023 10", None), ("1.5", None)])
def test_dates(spark, text, expected):
    got = one(spark, E.parse_day_first("c").cast("timestamp_ntz"), text)
    assert got == (None if expected is None else dt.datetime(*expected))


def test_spreadsheet_text_that_is_no_number(spark):
    for text, expected in (("NaN", "NaN"), ("inf", "inf"), ("-Infinity", "-Infinity"), ("45000", "15/03/2023"), ("15-03-2023", "15/03/2023")):
        assert one(spark, E.spreadsheet_date_text("c"), text) == expected


def test_character_references(spark):
    for text, expected in (("a&nbsp;b", "a\xa0b"), ("&#233;&#xE9;&#Xe9;", "ééé"), ("&eacute;&euro;&amp;lt;", "é€&lt;"), ("&#128;&#x93;", "€“"),
                           ("&#128512;", "😀"), ("&#0;&#xD800;&#99999999;", "�" * 3), ("&unknown; &&; a&b", "&unknown; &&; a&b"),
                           ("&copy 1", "© 1"), ("none", "none"), ("", ""), (None, None)):
        assert one(spark, E.decode_references("c"), text) == expected


def test_warranty_cells_with_references(spark):
    for cell, text, days in (("&nbsp;Garantia: 36 meses", "Garantia: 36 meses", 1095),
                             ("Garantia:&nbsp;36&nbsp;meses", "Garantia:\xa036\xa0meses", 1095),
                             ("<b>&#71;arantia</b> 12&#32;MESES", "Garantia 12 MESES", 365), ("x Garantia 12", E.dims.NOT_FOUND, None)):
        html = f"<table><tr><td>a</td><td class='x'>{cell}</td></tr></table>"
        assert one(spark, E.warranty_sentence("c"), html) == text
        assert one(spark, E.warranty_text_to_days(E.warranty_sentence("c")), html) == days


HEAD = '<table><tr><td>no</td></tr></table><TABLE class="a" border="1"><tr><th>Serial</th></tr>'
PAGES = {
    "plain": (HEAD + "<tr><td> A1 </td><td>ok</td></tr><tr><td></td></tr><tr><th>x</th></tr><tr><td>A&nbsp;<b> 2</b></td></tr></table>", ["A1", "A2"]),
    "inner": (HEAD + "<tr><td>B1<table><tr><td>in1</td></tr><tr><td>in2</td><td>z</td></tr></table>end</td><td>q</td></tr>"
              "<tr><td>B2</td></tr></table><table border=1><tr><td>h</td></tr><tr><td>other</td></tr></table>", ["B1in1in2zend", "in1", "in2", "B2"]),
    "second cell": (HEAD + "<tr><td>C1</td><td><table><tr><td>d</td></tr></table></td></tr></table>", ["C1", "d"]),
    "long": (HEAD + "<tr><td>D&#49;</td><td>" + "x" * 200_000 + "</td></tr><tr><td>D2</td></tr></table>", ["D1", "D2"]),
    "comment": (HEAD + "<!-- <table><tr><td>no</td></tr> --><tr><td>E1<table></table></td></tr></table>", ["E1"]),
    "only header": (HEAD + "<tr></tr></table>", []), "none": ("<p>no table</p>", []), "empty": ("", []), "null": (None, []),
    "not closed": (HEAD + "<tr><td>F1", []),
}


def test_serials_of_nested_tables(spark):
    table = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "page_key string, html string")
    got = {r["page_key"]: r["_serials"] for r in pages.page_serials(table).collect()}
    assert got == {k: v[1] for k, v in PAGES.items()}
    kinds = {r["page_key"] for r in table.where(pages.is_nested(F.col("html"))).collect()}
    assert kinds == {"inner", "second cell", "long", "comment"}
    # the tags give the same serials where the regex is enough
    by_tags = {r["page_key"]: r["_serials"] for r in pages.nested_serials(table, "page_key").collect()}
    assert by_tags["plain"] == ["A1", "A2"]


def test_report_cells(spark):
    html = ("<table><tr><th>Data</th><th>Cliente</th></tr><tr><td>01/02/2024</td><td>Jo&atilde;o &amp; <i>Cia</i></td></tr>"
            "<tr><td>&nbsp;</td><td>x</td></tr><tr><td>Total</td><td>2</td></tr></table>")
    rows = pages.report_rows(spark.createDataFrame([("p", html)], "page_key string, html string")).orderBy("pos").collect()
    assert [r["cells"] for r in rows] == [["01/02/2024", "João & Cia"], ["", "x"]]
