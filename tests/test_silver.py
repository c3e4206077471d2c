"""Silver tables: pruning, refresh of touched years, and the search index."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldlens.operators import filters
from fieldlens.plans import silver

SF = "/root/testdata/sf0.001"
ROW = "SS string, TAREFA string, INICIO timestamp_ntz, FIM timestamp_ntz, SUMARIO string, TAGS array<string>"


def d(y, m=1, day=1):
    return dt.datetime(y, m, day)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """The partition filters of every scan of the plan."""
    return [line for line in df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line]


def test_years_are_partition_filters(spark):
    qs = entry.queries()
    assert any("ANO" in s and ">= 1997" in s for s in scans(qs["silver_date_filter"](spark, SF)))
    plan = qs["silver_date_filter"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(INICIO" in plan and "LessThanOrEqual(FIM" in plan
    assert any("ANO_NF" in s and ">= 1996" in s and "<= 2000" in s for s in scans(qs["silver_installed_base_filter"](spark, SF)))
    assert any("dynamicpruning" in s for s in scans(qs["silver_search_serial"](spark, SF)))


@pytest.fixture()
def table(spark, tmp_path):
    years = [1999, 2000, 2001, None]
    rows = [(str(i), "1", None if years[i % 4] is None else d(years[i % 4], 1 + i % 12), None, f"texto {i:04d}", ["A", f"T{i % 3}"]) for i in range(400)]
    rows += [("x1", "1", d(2001), None, "STRASSE ΟΔΟΣ", None), ("x2", "1", d(2001), None, "İSTANBUL", ["Ü"]),
             ("x3", "1", None, None, "straße, ab", []), ("x4", "1", d(1999), None, None, None), ("x5", "1", d(1999), None, "a.c a+c", None)]
    path = str(tmp_path / "tickets")
    tickets = spark.createDataFrame(rows, ROW)
    silver.write_tickets(tickets, path, blocks=4)
    silver.write_text_index(spark.read.parquet(path), str(tmp_path / "index"))
    return path, spark.read.parquet(path), spark.read.parquet(str(tmp_path / "index"))


@pytest.mark.parametrize("term", ["texto 0007", "0007", "o 03", "strasse", "STRASSE", "straße", "οδος", "οδοσ", "istanbul", "İSTANBUL",
                                  "t2", "A, T1", "zzz", "a.c", "a+c", "(", "ab", "ü", "texto"])
def test_search_equals_the_scan(spark, table, term):
    _, tickets, index = table
    if term == "(":
        term = r"\("
    names = ["SS", "TAREFA", "INICIO", "FIM", "SUMARIO", "TAGS"]
    want = filters.search_any_column(tickets, term, names)
    got = silver.search(tickets, index, term)
    assert sorted(r["SS"] for r in got.collect()) == sorted(r["SS"] for r in want.collect())


def test_rare_terms_leave_blocks_unread(spark, table):
    _, tickets, index = table
    blocks = tickets.select("ANO", "_block").distinct().count()
    assert blocks > 12
    assert silver.candidate_blocks(index, "texto 0007").count() < blocks / 3
    assert silver.candidate_blocks(index, "texto").count() >= blocks - 1
    assert silver.candidate_blocks(index, "qqqq").count() == 0


def test_refresh_replaces_only_years_with_rows(spark, table):
    path, tickets, _ = table
    before = tickets.groupBy("ANO").count().collect()
    files = {f for f in tickets.inputFiles() if "ANO=2000/_block=1/" not in f}
    new = spark.createDataFrame([("n1", "1", d(2000, 5), None, "novo", None)], ROW).withColumns(
        {"ANO": F.lit(2000), "_block": F.lit(1)})
    silver.write_partitioned(new, path, ["ANO", "_block"], ["INICIO"])
    after = spark.read.parquet(path)
    assert files <= set(after.inputFiles())
    assert {r["ANO"]: r["count"] for r in after.where("ANO <> 2000").groupBy("ANO").count().collect()} \
        == {r["ANO"]: r["count"] for r in before if r["ANO"] not in (2000, None)}
    assert after.where("ANO = 2000 AND _block = 1").count() == 1
    assert {r[0] for r in silver.between(after, dt.date(2001, 1, 1)).select("ANO").distinct().collect()} == {2001}


def test_silver_is_written_once_per_input(spark):
    from fieldlens.sources.tables import Tables
    a, b = silver.Silver(Tables(spark, SF)), silver.Silver(Tables(spark, SF))
    assert a.paths == b.paths
    assert silver.Silver(Tables(spark, "/root/testdata/sf0.01"), blocks=2).paths != a.paths
