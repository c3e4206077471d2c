"""Scalar expressions (F-1 and the G-fixtures of FIXTURES.md)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import expr as E


def col_values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


# F-1: warranty labels -------------------------------------------------------
@pytest.mark.parametrize("days,label", [
    (183.0, "6 meses (183 dias)"), (365.0, "12 meses (365 dias)"), (548.0, "18 meses (548 dias)"),
    (730.0, "24 meses (730 dias)"), (1095.0, "36 meses (1095 dias)"),
])
def test_f1a_standard_periods(spark, days, label):
    assert col_values(spark, [(days,)], "g double", E.warranty_label("g")) == [label]


def test_f1b_missing_values(spark):
    out = col_values(spark, [(float("nan"),), (None,), (float("nan"),)], "g double", E.warranty_label("g"))
    assert out == ["Não informado"] * 3


def test_f1c_zero(spark):
    assert col_values(spark, [(0.0,), (0.0,)], "g double", E.warranty_label("g")) == ["Não informado"] * 2
    # text '0' is not treated as missing (decided in the quirk register)
    assert col_values(spark, [("0",)], "g string", E.warranty_label("g", text=True)) == ["Outros"]


def test_f1d_empty_text(spark):
    assert col_values(spark, [("",)], "g string", E.warranty_label("g", text=True)) == ["Não informado"]


def test_f1e_infinities(spark):
    out = col_values(spark, [(math.inf,), (-math.inf,)], "g double", E.warranty_label("g"))
    assert out == ["Outros", "Outros"]


def test_f1f_negative(spark):
    out = col_values(spark, [(-1.0,), (-100.0,), (-365.0,)], "g double", E.warranty_label("g"))
    assert out == ["Outros"] * 3


def test_f1g_too_large(spark):
    out = col_values(spark, [(10000.0,), (100000.0,), (1e10,)], "g double", E.warranty_label("g"))
    assert out == ["Outros"] * 3


def test_f1h_numeric_text(spark):
    out = col_values(spark, [("365",), ("730",), ("183",)], "g string", E.warranty_label("g", text=True))
    assert out == ["12 meses (365 dias)", "24 meses (730 dias)", "6 meses (183 dias)"]


def test_f1i_junk_text(spark):
    out = col_values(spark, [("abc",), ("not a number",), ("12x",)], "g string", E.warranty_label("g", text=True))
    assert out == ["Outros"] * 3


def test_f1j_non_standard_ints(spark):
    out = col_values(spark, [(100,), (200,), (500,), (800,)], "g int", E.warranty_label("g"))
    assert out == ["Outros"] * 4


# G-3: aging -----------------------------------------------------------------
def test_g3_aging(spark):
    as_of = dt.date(2025, 3, 1)
    rows = [
        (dt.datetime(2025, 1, 1, 0), dt.datetime(2025, 1, 1, 23), "FECHADO"),  # 23 h -> 0
        (dt.datetime(2025, 2, 20), None, "ABERTO"),                            # runs to as_of -> 9
        (dt.datetime(2025, 2, 20), None, "FECHADO"),                           # no end -> null
        (dt.datetime(2025, 2, 10), dt.datetime(2025, 2, 9, 12), "FECHADO"),    # end before start -> -1
    ]
    df = spark.createDataFrame(rows, "ini timestamp_ntz, fim timestamp_ntz, st string")
    out = [r[0] for r in df.select(E.aging_days("ini", "fim", "st", as_of)).collect()]
    assert out == [0, 9, None, -1]


# G-4: warranty text -> days ---------------------------------------------------
G4 = ["GARANTIA: 36 MESES", "12 MONTHS", "2 ANOS", "30 MESES", "7 M", "11 ANOS", "5 YEARS",
      "NAO ENCONTRADO", "", None, "730", "365,0"]


def test_g4_canonical(spark):
    out = col_values(spark, [(x,) for x in G4], "g string", E.warranty_text_to_days("g"))
    assert out == [1095, 365, 730, 1095, 365, None, None, None, None, None, 730, 365]


def test_g4_legacy(spark):
    out = col_values(spark, [(x,) for x in G4], "g string", E.warranty_text_to_days("g", "legacy"))
    # dictionary-order scan: "36 MESES" hits "6 MESES" (183); "11 ANOS" hits "1 ANO" (365)
    assert out[:7] == [183, 365, 730, 913, 213, 365, 1825]
    assert out[7:] == [0, 0, 0, 730, 365]


def test_g4_numeric(spark):
    out = col_values(spark, [(x,) for x in G4], "g string", E.warranty_text_to_days("g", "numeric"))
    assert out == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 730, 365]


# G-5: serials -------------------------------------------------------------------
def test_g5_serial(spark):
    rows = [(" 123.0 ",), ("1.05.0",), ("",), (None,), ("N/A",)]
    assert col_values(spark, rows, "c string", E.clean_serial("c")) == ["123", "1.05", "N/A", "N/A", "N/A"]
    assert col_values(spark, rows, "c string", E.clean_serial("c", legacy=True)) == ["123", "15", "N/A", "N/A", "N/A"]


# G-6: tags ----------------------------------------------------------------------
def test_g6_tags(spark):
    rows = [("[a] x [ B ][a]",), ("none",), (None,), ("[]",)]
    out = col_values(spark, rows, "t string", E.extract_tags("t"))
    assert out == [["A", "B"], ["Sem Tags"], ["Sem Tags"], ["Sem Tags"]]


# G-7: addresses -------------------------------------------------------------------
def test_g7_addresses(spark):
    rows = [("Rua X, Cidade, SP, BR",), ("A, XX, BR, extra",), ("no code",), (None,)]
    assert col_values(spark, rows, "a string", E.state_from_address("a")) == ["SP", "XX", None, None]
    assert col_values(spark, rows, "a string", E.country_from_address("a")) == ["BR", None, None, None]


# G-8: spreadsheet dates ------------------------------------------------------------
def test_g8_spreadsheet_dates(spark):
    rows = [("45000",), ("45000,5",), ("03/02/2024",), ("free text",), (None,)]
    out = col_values(spark, rows, "v string", E.spreadsheet_date_text("v"))
    assert out == ["15/03/2023", "15/03/2023", "03/02/2024", "free text", ""]


# G-9: item prefix -> model ------------------------------------------------------------
def test_g9_model(spark):
    rows = [("W7HX2-1",), ("w7hx2 -9",), ("ZZZ-1",), ("7502A",), (None,)]
    out = col_values(spark, rows, "i string", E.model_from_prefix(E.item_prefix("i")))
    assert out == ["HELIX", "HELIX", "OUTROS", "7502A", "OUTROS"]


def test_day_first_dates(spark):
    rows = [("03/02/2024",), ("3/2/2024 10:30",), ("2024-02-03",), ("31/02/2024",), ("x",)]
    out = col_values(spark, rows, "d string", E.parse_day_first("d").cast("date"))
    assert out == [dt.date(2024, 2, 3), dt.date(2024, 2, 3), dt.date(2024, 2, 3), None, None]


def test_decimal_comma_and_lenient_int(spark):
    rows = [("1234,5",), (None,), ("abc",), ("365.7",)]
    assert col_values(spark, rows, "v string", E.decimal_comma_number("v")) == [1234.5, 0.0, 0.0, 365.7]
    assert col_values(spark, rows, "v string", E.lenient_int("v")) == [0, 0, 0, 365]


def test_currency_and_pump_code(spark):
    assert col_values(spark, [(1234.56,)], "v double", E.currency_text("v")) == ["R$ 1.234,56"]
    rows = [("BOMBA MEDIDORA DE COMBUSTIVEIS LIQUIDOS - X1 - Y",), ("BOMBA MEDIDORA DE COMBUSTIVEIS LIQUIDOS",),
            ("OUTRA - X",), (None,)]
    assert col_values(spark, rows, "d string", E.pump_code("d")) == ["X1", "", "", ""]


def test_warranty_status_and_electronic(spark):
    as_of = dt.date(2025, 1, 1)
    rows = [(dt.date(2024, 6, 1), 365), (dt.date(2023, 6, 1), 365), (None, 365), (dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "d date, g int")
    out = df.select(E.warranty_status("d", "g", as_of), E.electronic_warranty_status("d", as_of)).collect()
    assert [tuple(r) for r in out] == [("DENTRO", "DENTRO"), ("FORA", "FORA"), ("", "FORA"), ("", "FORA")]


def test_no_python_udfs_in_expressions(spark):
    df = spark.createDataFrame([("W7HX2-1 [a]", 1.0)], "t string, v double")
    plan = df.select(E.extract_tags("t"), E.warranty_text_to_days("t"), E.model_from_prefix(E.item_prefix("t")),
                     E.warranty_label("v"), E.currency_text("v"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_aging_ignores_session_time_zone(spark):
    # 1999-10-03 was a 23-hour day in Sao Paulo; wall-clock aging must not see it
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.createDataFrame([(dt.datetime(1999, 10, 2), dt.datetime(1999, 10, 4), "FECHADO")],
                                   "ini timestamp_ntz, fim timestamp_ntz, st string")
        assert df.select(E.aging_days("ini", "fim", "st", dt.date(2000, 1, 1))).first()[0] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
