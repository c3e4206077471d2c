"""Incremental update jobs (G-12): rerun-safe, watermark defaults, rejects."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fieldlens.streaming import incremental


def tickets(spark):
    d = dt.datetime
    return spark.createDataFrame([
        ("1", "1", "FECHADO", d(2025, 1, 5)), ("2", "1", "ABERTO", d(2025, 2, 10)),
        ("3", "1", "FECHADO", d(2025, 3, 1)), ("4", "1", "FECHADO", None), ("5", "1", None, d(2025, 1, 7)),
    ], "SS string, TAREFA string, STATUS string, DATA timestamp_ntz")


def test_watermark_and_resplit(spark):
    as_of = dt.date(2025, 4, 15)
    t = tickets(spark)
    wm = incremental.oldest_open(t, as_of)
    assert wm.first()[0] == dt.date(2025, 2, 10)
    r = {x["SS"]: x["destino"] for x in incremental.resplit(t, wm).collect()}
    assert r == {"1": "historico", "2": "atual", "3": "atual", "4": None, "5": "historico"}
    m = [(x["inicio"], x["fim"]) for x in incremental.month_ranges(wm, as_of).orderBy("mes").collect()]
    assert m[0] == (dt.date(2025, 2, 10), dt.date(2025, 2, 28)) and m[-1] == (dt.date(2025, 4, 1), as_of)
    closed = t.where("STATUS = 'FECHADO'")
    assert incremental.oldest_open(closed, as_of).first()[0] == as_of


def test_rerun_adds_nothing(spark, tmpdir_path):
    t = tickets(spark)
    hist = incremental.merge_history(None, t.where("SS = '1'"), ["SS", "TAREFA"], [F.col("DATA")])
    again = incremental.merge_history(hist, t.where("SS = '1'"), ["SS", "TAREFA"], [F.col("DATA")])
    assert again.count() == hist.count() == 1
    new = incremental.append_new(hist, t, ["SS", "TAREFA"])
    assert sorted(r["SS"] for r in new.collect()) == ["2", "3", "4", "5"]
    p = incremental.write_version(new, os.path.join(tmpdir_path, "out"), "1")
    assert spark.read.parquet(p).count() == 4


def test_watermark_roundtrip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "wm")
    assert incremental.read_watermark(spark, path, dt.date(2025, 1, 1)).first()[0] == dt.date(2025, 1, 1)
    incremental.write_watermark(incremental.oldest_open(tickets(spark), dt.date(2025, 4, 1)), path)
    assert incremental.read_watermark(spark, path, dt.date(2025, 1, 1)).first()[0] == dt.date(2025, 2, 10)


def test_streaming_append_is_rerun_safe(spark, tmpdir_path):
    from fieldlens.streaming import twin
    schema = "PEDIDO string, LINHA string, ITEM string, Serial string"
    src = os.path.join(tmpdir_path, "landing")
    target = os.path.join(tmpdir_path, "unpacked")
    spark.createDataFrame([("1", "1", "A", "S1"), ("1", "2", "B", "S2")], schema).write.parquet(os.path.join(src, "f1"))
    st = spark.read.parquet(os.path.join(src, "f1")).schema
    keys = ["PEDIDO", "LINHA", "ITEM", "Serial"]
    twin.append_new_keys_stream(spark, os.path.join(src, "*"), st, target, keys, os.path.join(tmpdir_path, "ck1"))
    # a second extract repeats one line and adds one; a fresh checkpoint replays everything
    spark.createDataFrame([("1", "2", "B", "S2"), ("2", "1", "C", "S3"), ("2", "1", "C", "S4"), ("2", "1", "C", "S5"),
                           ("1", "1", "A", "S9")], schema).write.parquet(os.path.join(src, "f2"))
    twin.append_new_keys_stream(spark, os.path.join(src, "*"), st, target, keys, os.path.join(tmpdir_path, "ck2"))
    rows = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    assert rows == [("1", "1", "A", "S1"), ("1", "1", "A", "S9"), ("1", "2", "B", "S2"),
                    ("2", "1", "C", "S3"), ("2", "1", "C", "S4"), ("2", "1", "C", "S5")]


def test_update_twice_gives_the_same_tables(spark):
    as_of = dt.date(2025, 4, 15)
    t = tickets(spark)
    once = incremental.update_tickets(t, None, None, as_of, ["SS", "TAREFA"], [F.col("DATA")])
    again = incremental.update_tickets(t, once["current"].unionByName(once["rejects"]), once["history"], as_of,
                                       ["SS", "TAREFA"], [F.col("DATA")])
    for name, want in (("history", ["1", "5"]), ("current", ["2", "3"]), ("rejects", ["4"])):
        assert sorted(r["SS"] for r in once[name].collect()) == want
        assert sorted(r["SS"] for r in again[name].collect()) == want


def test_only_a_missing_path_is_a_first_run(spark, tmpdir_path):
    import pytest

    broken = os.path.join(tmpdir_path, "broken")
    os.makedirs(broken)
    with open(os.path.join(broken, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    assert incremental.read_if_present(spark, os.path.join(tmpdir_path, "none"), "a int") is None
    with pytest.raises(Exception):
        incremental.read_watermark(spark, broken, dt.date(2025, 1, 1)).collect()


def test_last_watermark_counts(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "wm")
    for day in (3, 1, 2):
        incremental.write_watermark(spark.range(1).select(F.lit(dt.date(2025, 1, day)).alias("oldest_open")), path)
    assert incremental.read_watermark(spark, path, dt.date(2024, 1, 1)).first()[0] == dt.date(2025, 1, 2)
