"""The silver build leaves no shuffle files and holds those of one slice at a time; slices give the rows of the whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldlens.plans import jobs, silver
from fieldlens.session import released_shuffles
from fieldlens.sources import views
from fieldlens.sources.tables import Tables

DAY = dt.datetime(1996, 3, 1)


@pytest.fixture()
def t(spark, tmp_path):
    """Tables with nulls, missing partners and rows that come twice."""
    lines = [(n // 3, n % 7 or None, n % 5, n % 3 + 1, float(n % 9), 10.0 + n % 4, "AFRN"[n % 4], "OF"[n % 2], DAY + dt.timedelta(days=31 * (n % 60)))
             for n in range(240)]
    lines += lines[:40] + [(None, 1, 1, 1, 1.0, 1.0, "A", "O", DAY), (5, 1, 1, None, 2.0, 1.0, None, None, DAY), (6, 1, 1, 4, None, None, "R", "F", None),
                           (999, 1, 1, 1, 1.0, 1.0, "A", "O", DAY), (7, 2, 2, 1, 8.0, 99.0, "N", "F", DAY + dt.timedelta(days=4000))]
    orders = [(n, n % 11, "OFP"[n % 3], DAY, ["1-URGENT", "2-HIGH", "5-LOW", None][n % 4]) for n in range(80)] + [(3, 4, "F", DAY, "5-LOW"), (None, 1, "O", DAY, "5-LOW")]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "supplier": ([(0, "S0", 1), (1, "S1", 2), (2, None, 3), (3, "S1", 4), (4, "S8", None), (1, "S1", 2), (None, "S9", 1)],
                     "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(n, f"anvil {n}", f"Brand#{n}", ["LARGE", None][n % 2], 5 * n) for n in range(1, 7)] + [(None, "x", "Brand#9", "SMALL", 1)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "customer": ([(n, f"C{n}", n % 2, "M") for n in range(11)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_slices_hold_the_tickets_of_the_whole(spark, t, tmp_path, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        want = silver.ticket_rows(jobs.build_tickets(t), 4)
        path = str(tmp_path / "tickets")
        silver.write_ticket_slices(t, path, views.AS_OF, 4, 5)
        got = spark.read.parquet(path)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        assert got.count() > got.dropDuplicates(["SS", "TAREFA"]).count() > 200  # an order comes twice
        silver.write_text_index(got, str(tmp_path / "index"), slices=3)
        index = spark.read.parquet(str(tmp_path / "index"))
        assert rows(index) == rows(silver.text_index(want)) and index.count() == index.distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_file_lie_by_date(spark, t, tmp_path):
    path = str(tmp_path / "tickets")
    silver.write_ticket_slices(t, path, views.AS_OF, 2, 2)
    for file in spark.read.parquet(path).inputFiles():
        days = [r[0] for r in spark.read.parquet(file).select("INICIO").collect()]
        assert days == sorted(days, key=lambda d: d or dt.datetime.min)


def test_the_build_holds_shuffle_files_of_one_slice(spark, t, monkeypatch):
    monkeypatch.setattr(silver, "SLICE_BYTES", 1 << 10, raising=False)
    seen, write, before = [], silver.write_units, shuffle_files(spark)
    monkeypatch.setattr(silver, "write_units", lambda *a: (seen.append(shuffle_files(spark)), write(*a)))
    made = silver.Silver(t, blocks=3)
    assert seen[0] <= before  # those of the tickets are gone when the units begin
    assert shuffle_files(spark) <= before
    assert made.tickets.count() == jobs.build_tickets(t).count()
    assert made.units.count() == jobs.build_installed_base(t, views.AS_OF).count()


def test_number_of_slices_is_bounded(t, monkeypatch):
    assert silver._slices(t) == 1
    monkeypatch.setattr(silver, "SLICE_BYTES", 1)
    assert silver._slices(t) == silver.MOST_SLICES


def test_released_shuffles_sets_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with released_shuffles(spark), released_shuffles(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(100).groupBy(F.col("id") % 3).count().count() == 3
    assert spark.conf.get(key, None) == before
