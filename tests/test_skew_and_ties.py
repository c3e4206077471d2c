"""Hot keys (one key with a third of all rows) and top-N tie behaviour (G-15)."""

import datetime as dt

from pyspark.sql import functions as F

from fieldlens.operators import charts, dedup, kpi


def test_hot_key_dedup_is_exact_and_map_side_combined(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("SS"),
        F.lit("1").alias("TAREFA"),
        F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz")).alias("DATA"),
        F.col("id").alias("payload"))
    out = dedup.latest_per_key(df, ["SS", "TAREFA"], [F.col("DATA")])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "partial_max" in plan  # combined before the shuffle
    rows = {r["SS"]: r["payload"] for r in out.collect()}
    assert len(rows) == 1 + (n - n // 3)
    assert rows["HOT"] == max(i for i in range(n) if i % 3 == 0)


def test_hot_serial_flags(spark):
    t = spark.range(9000).select(
        F.lit("1").alias("SS"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("CHASSI"),
        F.when(F.col("id") == 3, F.lit("PARTIDA INICIAL")).otherwise(F.lit("X")).alias("SERVICO"),
        F.when(F.col("id") % 2 == 0, F.lit("[STB]")).otherwise(F.lit("ok")).alias("SUMARIO"))
    f = {r["CHASSI"]: r for r in kpi.unit_ticket_flags(t).collect()}
    assert f["HOT"]["n_calls"] == 3000 and f["HOT"]["has_startup"] and f["HOT"]["n_valid_calls"] == 1500


def test_g15_top_n_ties_and_null_keys(spark):
    rows = [("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [("d",)] * 2 + [(None,)] * 5
    df = spark.createDataFrame(rows, "k string")
    top = [(r["value"], r["quantidade"]) for r in charts.value_counts_top(df, "k", 3).collect()]
    assert top == [("a", 3), ("b", 2), ("c", 2)]          # tie at the cut-off broken by key; null key dropped
    ag = spark.createDataFrame([("x", 5), ("y", 5), ("z", 1), (None, 9)], "M string, AGING int")
    assert [r["value"] for r in charts.aging_top_desc(ag, "M", 2).collect()] == ["x", "y"]
    assert [r["value"] for r in charts.aging_best(ag, "M", 2).collect()] == ["z", "x"]


def test_aging_buckets_always_three(spark):
    df = spark.createDataFrame([(0,), (7,), (-3,), (None,)], "AGING int")
    out = {r["bucket"]: r["quantidade"] for r in charts.aging_buckets(df).collect()}
    assert out == {"Até 7": 2, "8 a 14": 0, ">14": 0}


def test_month_trend_top_categories(spark):
    d = dt.datetime
    rows = [("A", d(2025, m, 1), 1) for m in (1, 2, 3)] + [("B", d(2025, 1, 1), 2)] + [("C", None, 3)]
    df = spark.createDataFrame(rows, "M string, DATA timestamp_ntz, AGING int")
    out = charts.aging_month_trend(df, "M", n=1).collect()
    assert {r["value"] for r in out} == {"A"} and len(out) == 3
