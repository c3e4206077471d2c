"""Lookups whose key holds a third of all rows, without a broadcast of the dimension."""

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import filters, joins, kpi
from fieldlens.plans import jobs

N = 400_000


@pytest.fixture()
def large_dimensions(spark):
    """As on a cluster: no dimension is below the broadcast threshold, no partitions are merged."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lines(spark):
    """A third of the lines on one item, a twelfth without an item, the rest on 20,000 items."""
    i = F.col("id")
    item = (F.when(i % 3 == 0, "HOT").when(i % 12 == 1, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("I"), (i % 20_000).cast("string"))))
    return spark.range(N).select(i.cast("string").alias("PEDIDO"), item.alias("ITEM"), F.lit("").alias("GARANTIA"))


def cache(spark):
    i = F.col("id")
    return (spark.range(20_000).select(F.concat(F.lit("I"), i.cast("string")).alias("ITEM"), (i % 1000).cast("string").alias("GARANTIA"))
            .unionByName(spark.createDataFrame([("HOT", "365")], "ITEM string, GARANTIA string")))


def rows_per_task(df):
    """Rows of each task of the join; all columns are used, so that it stays in the plan."""
    used = df.select(F.spark_partition_id().alias("task"), F.xxhash64(*df.columns).alias("h"))
    return sorted((r["n"] for r in used.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("h")).collect()), reverse=True)


def test_no_task_holds_the_hot_item(spark, large_dimensions):
    filled = jobs.fill_lines(lines(spark), cache(spark), "GARANTIA", "NAO ENCONTRADO")
    sizes = rows_per_task(filled)
    assert sum(sizes) == N and len(sizes) == 16 and sizes[0] < 2 * sizes[8]
    got = filled.groupBy(F.when(F.col("ITEM") == "HOT", "hot").when(F.col("ITEM").isNull(), "none").otherwise("item").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("GARANTIA") == "365").alias("days"),
        F.count_if(F.col("GARANTIA") == "NAO ENCONTRADO").alias("missing")).collect()
    by = {r["k"]: r for r in got}
    assert by["hot"]["days"] == by["hot"]["n"] == -(-N // 3)
    assert by["none"]["missing"] == by["none"]["n"] > 0 and by["item"]["missing"] == 0
    plain = lines(spark).drop("GARANTIA").join(cache(spark), "ITEM").where("ITEM LIKE 'I%'").select("PEDIDO", "GARANTIA")
    assert filled.where("ITEM LIKE 'I%'").select("PEDIDO", "GARANTIA").exceptAll(plain).isEmpty()


def test_hot_key_that_the_dimension_lacks(spark, large_dimensions):
    df = lines(spark).select("PEDIDO", "ITEM")
    dim = cache(spark).where("ITEM <> 'HOT'").withColumnRenamed("ITEM", "raw").withColumnRenamed("GARANTIA", "label")
    out = joins.lookup(df, "ITEM", dim, "label", default="?")
    sizes = rows_per_task(out)
    assert sum(sizes) == N and sizes[0] < 2 * sizes[8]
    assert out.where("ITEM = 'HOT'").select("label").distinct().collect()[0][0] == "?"


def test_tickets_and_units_of_a_hot_serial(spark, large_dimensions):
    i = F.col("id")
    serial = F.when(i % 3 == 0, "HOT").otherwise((i % 5000).cast("string"))
    tickets = spark.range(N).select(serial.alias("CHASSI"), i.cast("string").alias("SS"), F.lit("X").alias("SERVICO"), F.lit("s").alias("SUMARIO"))
    units = spark.range(N).select(serial.alias("NUM_SERIAL"), F.lit(None).cast("date").alias("DT_NUM_NF"), i.alias("ORDER_KEY"),
                                  F.concat(F.lit("M"), serial).alias("MODELO"), F.lit("DENTRO").alias("STATUS_GARANTIA"), F.lit("SIM").alias("RTM"))
    joined = kpi.tickets_with_units(tickets, units)
    sizes = rows_per_task(joined)
    assert sum(sizes) == N and sizes[0] < 2 * sizes[8]
    assert joined.where("MODELO <> concat('M', CHASSI) OR MODELO IS NULL").isEmpty()
    kept = filters.installed_base_filter(units, tickets.where("CHASSI = 'HOT' OR CHASSI < '2'"), calls=(1, N))
    sizes = rows_per_task(kept)
    assert sizes[0] < 2 * sizes[8]
    assert {r[0] for r in kept.select("NUM_SERIAL").distinct().collect()} >= {"HOT", "1"}
    by_class = {r["partida_inicial"]: r["n"] for r in kpi.startup_status_counts(units, tickets.where("CHASSI = 'HOT'")).collect()}
    assert by_class == {"SIM - TERCEIRO": -(-N // 3), "NÃO": N + N // -3}


def test_small_dimension_is_left_to_spark(spark):
    dim = spark.createDataFrame([("a", "x"), ("b", "y")], "raw string, label string")
    assert joins.fits_broadcast(spark.sql("SELECT * FROM VALUES ('a', 'x') AS t(raw, label)"))
    assert not joins.fits_broadcast(spark.range(10**9).select(F.col("id").cast("string")))
    out = joins.lookups(spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "m string, n int"), "m",
                        {"m": dim, "e": dim.where("raw = 'b'").unionByName(spark.createDataFrame([("c", "z")], "raw string, label string"))})
    assert sorted(map(tuple, out.select("n", "m", "e").collect())) == [(1, "x", ""), (2, "", "z"), (3, "", "")]


def test_errors_meet_tickets_whatever_the_blanks(spark):
    tickets = spark.createDataFrame([("9\t", "C1", "s", "t"), (" 8", "C2", "s", "t")], "SS string, CHASSI string, SERVICO string, SUMARIO string")
    flags = kpi.unit_ticket_flags(tickets, spark.createDataFrame([("9 ",), ("8",), (None,)], "SS string"))
    assert sorted((r["CHASSI"], r["has_error"]) for r in flags.collect()) == [("C1", True), ("C2", True)]
