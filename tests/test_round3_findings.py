"""Work that grew faster than the rows: the text index, the stream's table, pages, and plans read several times."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import charts, dedup, joins
from fieldlens.plans import catalog, silver
from fieldlens.sources import pages
from fieldlens.sources.tables import Tables
from fieldlens.streaming import twin
from fieldlens.streaming.published import Published


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_index_holds_all_trigrams(spark):
    texts = ["ABC abc", "\u0130STANBUL", "\u039f\u0394\u039f\u03a3 x", "Stra\u00dfe", "ab", "", None, "a\U0001f600b\u00e9", "ABC abc"]
    rows = [(2000 + n % 2, n % 3, t, dt.datetime(2000, 1, 1 + n)) for n, t in enumerate(texts)]
    tickets = spark.createDataFrame(rows, "ANO int, _block int, S string, D timestamp_ntz")
    index = silver.text_index(tickets)
    assert "lambdafunction" not in plan(index)  # cut by rows, folded once for each different text
    cut = F.explode(F.sequence(F.lit(1), F.length("t") - 2))
    upper = F.translate(F.upper("t"), "\u0130", "I")
    want = (tickets.select("ANO", "_block", F.explode(F.array("S", F.col("D").cast("string"))).alias("t"))
            .select("ANO", "_block", F.translate(F.lower(upper), "\u03c2", "\u03c3").alias("t")).where("length(t) >= 3")
            .select("ANO", "_block", "t", cut.alias("i")).selectExpr("ANO", "_block", "xxhash64(substr(t, i, 3))").distinct())
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, want.collect()))


def test_stream_batches_do_not_rewrite_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twin, "FAN_IN", 3, raising=False)
    root, keys, order = str(tmp_path / "t"), ["k"], ["d", "v"]
    batches = [[(str(i), b, f"v{b}") for i in range(b, b + 6)] + [(None, b, None)] for b in range(10)]
    frames = [spark.createDataFrame(b, "k string, d long, v string") for b in batches]
    schema, store, written = frames[0].schema, Published(spark, root), 0
    for n, f in enumerate(frames):
        before = set(os.listdir(os.path.join(root, "data"))) if n else set()
        twin.upsert(store, f, schema, keys, order, 2)
        new = set(os.listdir(os.path.join(root, "data"))) - before
        rows = sum(spark.read.schema(schema).parquet(os.path.join(root, "data", x)).count() for x in new)
        assert n not in (1, 3) or rows == len(batches[n])  # a batch adds its own rows only
        written += rows
    want = dedup.latest_per_key(frames[0].sparkSession.createDataFrame(sum(batches, []), schema), keys, [F.col(c) for c in order])
    got = twin.read_upserted(spark, root, schema)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(schema.names).collect()), key=repr)
    assert written <= 3 * sum(map(len, batches))
    assert all(len(p["folders"]) < 3 * 3 for p in store.latest()[1].values())


HTML = ('<table border="1"><tr><th>S</th></tr><tr><td>1<table><tr><td>2</td></tr></table>3</td><td>x</td></tr>'
        "<tr><td>4</td></tr></table><td>no</td>")


def test_nested_pages_are_read_where_they_lie(spark):
    df = spark.createDataFrame([("a", HTML), ("b", "<p>"), ("c", None)], "page_key string, html string")
    found = pages.nested_serials(df, "page_key")
    assert not any(x in plan(found) for x in ("Window", "Join", "Aggregate"))
    assert [tuple(r) for r in found.collect()] == [("a", ["123", "2", "4"])]


def test_serials_read_the_pages_once(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("a", HTML, 1), ("a", HTML.replace("4", "5"), 2), (None, HTML, 3)], "page_key string, html string, at int").write.parquet(path)
    found = pages.page_serials(spark.read.parquet(path), fetched="at")
    assert plan(found).count("parquet") == 1
    assert [tuple(r) for r in found.collect()] == [("a", ["123", "2", "5"])]


def test_rows_of_a_report_are_cut_once(spark):
    html = "<table><tr><th>a</th></tr><tr><td> x  y </td><td>J&amp;<b>K</b></td></tr><tr><td>t</td></tr></table>"
    found = pages.report_rows(spark.createDataFrame([("p", html)], "page_key string, html string"))
    assert plan(found).count("(?is)<tr[^>]*>") == 1
    assert found.first().cells == ["x y", "J& K"]


def test_branches_over_a_shared_plan_reuse_its_shuffles(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id", (F.col("id") * 2).alias("x"))
    one = joins.shared(rows.groupBy("k").agg(F.max("id").alias("id"), F.max("x").alias("x")))
    both = one.where("k < 3").select("k", "id").unionByName(one.where("k >= 3").select("k", F.col("x").alias("id")))
    assert sorted(r.k for r in both.collect()) == list(range(7))
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_sorts_a_named_column_once(spark):
    rows = [("a", 1, None, "x"), ("a", None, 9, "y"), ("a", 1, 2, "z"), ("b", None, None, None), (None, 3, 1, "n"), (None, 3, 1, "m")]
    df = spark.createDataFrame(rows, "k string, d int, p long, v string")
    found = dedup.latest_per_key(df, ["k"], ["d", "p"])
    assert found.columns == df.columns
    assert {tuple(r) for r in found.collect()} == {("a", 1, 2, "z"), ("b", None, None, None), (None, 3, 1, "n")}
    packed = next(line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if "_best#" in line and "Aggregate" in line)
    assert packed.count("d#") == 1 and packed.count("p#") == 1
    first = dedup.first_per_key(df, ["k"], ["d", "p"])
    assert {tuple(r) for r in first.collect()} == {("a", 1, 2, "z"), ("b", None, None, None), (None, 3, 1, "m")}


@pytest.fixture()
def shuffle_joins(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_lookup_carries_no_column_that_nobody_uses(spark, tmp_path, shuffle_joins):
    path = str(tmp_path / "t")
    rows = [(str(i), None if i % 9 == 0 else "HOT" if i % 3 else f"k{i}", "long text") for i in range(300)]
    spark.createDataFrame(rows, "id string, raw_name string, unused string").write.parquet(path)
    dim = spark.createDataFrame([("HOT", "h")] + [(f"k{i}", f"v{i}") for i in range(0, 300, 2)], "raw string, label string")
    found = joins.lookups(spark.read.parquet(path), "raw_name", {"found": dim}, spread=["id"]).select("id", "found")
    read = [x.partition("ReadSchema:")[2] for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "ReadSchema:" in x]
    assert any("raw_name" in x for x in read) and not any("unused" in x for x in read)
    want = {i: "" if n is None else "h" if n == "HOT" else f"v{n[1:]}" if int(n[1:]) % 2 == 0 else "" for i, n, _ in rows}
    assert {r.id: r.found for r in found.collect()} == want and found.count() == len(rows)


def test_option_counts_shuffle_only_keys_for_the_units(spark, tmp_path, shuffle_joins):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = lambda y: dt.datetime(y, 3, 1)
    # a repeated part and supplier double the rows of a ticket; one order has no customer, one ticket no date
    save("lineitem", [(o, 1 + o % 3, o % 4, n, 5.0, 1.0, "ARN"[o % 3], "FO"[n % 2], day(1993 + o % 4) if o != 7 else None) for o in range(20) for n in (1, 2, 2)],
         "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    save("orders", [(o, o % 6 if o != 3 else None, "FOP"[o % 3], day(1998), "1-URGENT" if o % 2 else "5-LOW") for o in range(19)],
         "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")
    save("customer", [(c, f"C{c}", 1, "S") for c in range(5)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    save("nation", [(1, "BRAZIL", 1)], "n_nationkey int, n_name string, n_regionkey int")
    save("region", [(1, "AMERICA")], "r_regionkey int, r_name string")
    save("supplier", [(s, f"S{s}", s) for s in (0, 1, 2, 3, 3)], "s_suppkey long, s_name string, s_nationkey int")
    save("part", [(p, f"name {p}", "B#1", "TYPE", p * 5) for p in (1, 2, 3, 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    t = Tables(spark, str(tmp_path))
    found = catalog.q_filter_option_counts(t)
    got = {tuple(r) for r in found.collect()}
    assert got == {tuple(r) for r in charts.option_counts(catalog._tickets_full(t)).collect()}
    assert {f for f, _, _ in got} == {*charts.TICKET_OPTION_COLUMNS, "TAGS"}
    # below the sort for the join with the units there is the key, no label or tag of the ticket
    p = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in p.splitlines() if "AS _lh#" in line and "CHASSI" in line]
    assert dealt and not any("TAGS" in line or "ESPECIALISTA" in line or "SUMARIO" in line for line in dealt)
