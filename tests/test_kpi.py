"""Installed-base KPIs (F-2 .. F-5, G-13, G-14)."""

import datetime as dt

from pyspark.sql import functions as F

from fieldlens.operators import kpi
from fieldlens.operators import filters

UNITS = "NUM_SERIAL string, RTM string, DT_NUM_NF date, ANO_NF int, STATUS_GARANTIA string, GARANTIA int, ORDER_KEY long"
TICKETS = "SS string, CHASSI string, SERVICO string, SUMARIO string"


def units(spark, rows):
    return spark.createDataFrame(rows, UNITS)


def test_f2_distribution(spark):
    empty = spark.createDataFrame([], "GARANTIA int")
    assert list(kpi.warranty_distribution(empty).first()) == [0.0] * 5
    other = spark.createDataFrame([(1,), (2,), (3,)], "OTHER_COL int").withColumn("GARANTIA", F.lit(None).cast("int"))
    assert list(kpi.warranty_distribution(other).first()) == [0.0] * 5
    df = spark.createDataFrame([(365,), (365,), (730,), (730,)], "GARANTIA int")
    r = kpi.warranty_distribution(df).first().asDict()
    assert r["pct_12m"] == 50.0 and r["pct_24m"] == 50.0 and r["pct_6m"] == 0.0


def _f3(spark):
    u = units(spark, [
        ("A", "SIM", dt.date(2022, 1, 15), 2022, "DENTRO", 365, 1),
        ("A", "SIM", dt.date(2023, 6, 1), 2023, "DENTRO", 365, 2),
        ("B", "SIM", dt.date(2022, 3, 20), 2022, "FORA", 365, 3),
        ("C", "SIM", dt.date(2023, 2, 10), 2023, "DENTRO", 730, 4),
        ("D", "SIM", dt.date(2023, 8, 5), 2023, "FORA", 730, 5),
        ("E", "SIM", dt.date(2024, 1, 20), 2024, "DENTRO", 1095, 6),
    ])
    t = spark.createDataFrame([("100", "A", "PARTIDA INICIAL", "x")], TICKETS)
    e = spark.createDataFrame([], "SS string")
    return u, t, e


def test_f3_total_is_sum_of_years(spark):
    u, t, e = _f3(spark)
    rows = {r["ano"]: r for r in kpi.rtm_analysis_by_year(u, t, e, "SIM", dt.date(2025, 1, 1)).collect()}
    assert [rows[y]["units_sales"] for y in ("2022", "2023", "2024")] == [2, 3, 1]
    assert rows["Total"]["units_sales"] == 6
    # A has a start-up; 1 of 5 distinct serials overall
    assert rows["Total"]["start_up_own"] == 20.0


def test_f4_empty(spark):
    u = units(spark, [])
    t = spark.createDataFrame([], TICKETS)
    assert kpi.rtm_analysis_by_year(u, t, spark.createDataFrame([], "SS string"), "SIM", dt.date(2025, 1, 1)).count() == 0


def test_f5_general_at_least_electronic(spark):
    as_of = dt.date(2025, 1, 1)
    d = lambda n: as_of - dt.timedelta(days=n)
    u = units(spark, [("A", "SIM", d(100), d(100).year, "DENTRO", 365, 1),
                      ("B", "SIM", d(100), d(100).year, "", None, 2),
                      ("C", "SIM", d(500), d(500).year, "FORA", 365, 3)])
    t = spark.createDataFrame([], TICKETS)
    for r in kpi.rtm_analysis_by_year(u, t, spark.createDataFrame([], "SS string"), "SIM", as_of).collect():
        assert r["pct_under_warranty"] >= r["pct_under_electronic_warranty"]


def test_g13_startup_filter(spark):
    u = units(spark, [("S1", "SIM", dt.date(2020, 1, 1), 2020, "DENTRO", 365, 1),   # no tickets at all
                      ("S2", "SIM", dt.date(2020, 1, 1), 2020, "DENTRO", 365, 2),   # only an [STB] ticket
                      ("S3", "SIM", dt.date(2020, 1, 1), 2020, "DENTRO", 365, 3),   # a real call
                      ("S4", "SIM", dt.date(2020, 1, 1), 2020, "DENTRO", 365, 4)])  # start-up
    t = spark.createDataFrame([("1", "S2", "CORRETIVA", "[STB] x"), ("2", "S3", "CORRETIVA", "y"),
                               ("3", "S4", "PARTIDA INICIAL", "z")], TICKETS)

    def pick(cls):
        return sorted(r[0] for r in filters.installed_base_filter(u, t, startup=cls).select("NUM_SERIAL").collect())

    assert pick("NÃO") == ["S1", "S2"]
    assert pick("SIM - TERCEIRO") == ["S3"]
    assert pick("SIM - DFS") == ["S4"]


def test_g14_empty_and_duplicates(spark):
    empty = units(spark, [])
    t = spark.createDataFrame([], TICKETS)
    assert list(kpi.installed_base_kpis(empty, t).first()) == [0.0] * 7
    dup = units(spark, [("A", "SIM", None, None, "DENTRO", 365, 1), ("A", "SIM", None, None, "DENTRO", 365, 2)])
    r = kpi.installed_base_kpis(dup, t).first().asDict()
    # distinct serials over rows (kept on purpose): 1 of 2 rows
    assert r["pct_rtm"] == 50.0 and r["pct_em_garantia"] == 50.0
    tk = spark.createDataFrame([], "STATUS string, AGING int, GARANTIA string, RTM string")
    r = kpi.ticket_kpis(tk).first().asDict()
    assert r["total"] == 0 and r["pct_rtm"] == 0.0
