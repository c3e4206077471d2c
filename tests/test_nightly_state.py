"""C6 by order of arrival, kept on storage, and the upsert twin M4."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import dedup
from fieldlens.streaming import incremental, twin
from fieldlens.streaming.published import AlreadyPublished, Published

AS_OF = dt.date(2025, 4, 15)
KEYS = ["SS", "TAREFA"]
ROW = "SS string, TAREFA string, STATUS string, DATA timestamp_ntz, MANTENEDOR string"


def d(month, day):
    return dt.datetime(2025, month, day)


def rows(df):
    return sorted((r["SS"], r["STATUS"], r["MANTENEDOR"], r["DATA"]) for r in df.collect())


def test_the_row_that_arrived_last_wins(spark):
    base = spark.createDataFrame([
        ("1", "1", "FECHADO", d(1, 5), "A"),    # reopened
        ("2", "1", "ABERTO", d(1, 2), "A"),     # closed since
        ("3", "1", "ABERTO", d(3, 1), "A"),     # reassigned
        ("4", "1", "ABERTO", d(2, 1), "A"),     # not fetched again
        ("5", "1", "ABERTO", None, "A"),        # date known since
        ("6", "1", "FECHADO", d(3, 3), "Z"),    # later date, but fetched earlier
    ], ROW)
    new = spark.createDataFrame([
        ("1", "1", "ABERTO", d(1, 5), "A"), ("2", "1", "FECHADO", d(1, 2), "A"), ("3", "1", "ABERTO", d(3, 1), "B"),
        ("5", "1", "FECHADO", d(3, 9), "A"), ("6", "1", "FECHADO", d(3, 2), "A"), ("7", "1", None, d(1, 1), "A"),
        ("8", "1", "FECHADO", d(1, 1), "B"), ("9", "1", "ABERTO", None, "B")], ROW)
    history = spark.createDataFrame([("1", "1", "FECHADO", d(1, 5), "OLD"), ("8", "1", "FECHADO", d(1, 1), "OLD"),
                                     ("10", "1", "FECHADO", d(1, 1), "OLD")], ROW)
    for _ in range(2):  # the second night over the same rows changes nothing
        out = incremental.update_tickets(new, base, history, AS_OF, KEYS, [F.col("DATA")])
        assert out["watermark"].first()[0] == dt.date(2025, 1, 5)
        assert rows(out["current"]) == [("1", "ABERTO", "A", d(1, 5)), ("3", "ABERTO", "B", d(3, 1)), ("4", "ABERTO", "A", d(2, 1)),
                                        ("5", "FECHADO", "A", d(3, 9)), ("6", "FECHADO", "A", d(3, 2))]
        assert rows(out["history"]) == [("10", "FECHADO", "OLD", d(1, 1)), ("2", "FECHADO", "A", d(1, 2)),
                                        ("7", None, "A", d(1, 1)), ("8", "FECHADO", "B", d(1, 1))]
        assert rows(out["rejects"]) == [("9", "ABERTO", "B", None)]
        base, history = out["current"].unionByName(out["rejects"]), out["history"]


def state(spark, root, schema):
    return {n: rows(f) for n, f in incremental.read_state(spark, root, schema, KEYS).items()}


def test_nights_on_storage(spark, tmp_path, monkeypatch):
    root, order = str(tmp_path / "tickets"), [F.col("DATA")]
    first = spark.createDataFrame([("1", "1", "ABERTO", d(2, 10), "A"), ("2", "1", "FECHADO", d(1, 5), "A"),
                                   ("3", "1", "FECHADO", d(3, 1), "A"), ("4", "1", "FECHADO", None, "A")], ROW)
    schema = first.schema
    assert state(spark, root, schema) == {"current": [], "rejects": [], "history": []}
    assert incremental.stored_watermark(spark, root, dt.date(2023, 1, 1)) == dt.date(2023, 1, 1)
    assert incremental.run_update(spark, root, first, AS_OF, KEYS, order) == 1
    night = {"current": [("1", "ABERTO", "A", d(2, 10)), ("3", "FECHADO", "A", d(3, 1))],
             "history": [("2", "FECHADO", "A", d(1, 5))], "rejects": [("4", "FECHADO", "A", None)]}
    assert state(spark, root, schema) == night
    folders = Published(spark, root).latest()[1]["history"]
    assert incremental.run_update(spark, root, first, AS_OF, KEYS, order) == 2
    assert state(spark, root, schema) == night and Published(spark, root).latest()[1]["history"] == folders
    # a run that dies before it publishes changes nothing, the next one repeats it
    second = spark.createDataFrame([("1", "1", "FECHADO", d(2, 10), "B"), ("2", "1", "ABERTO", d(1, 5), "A"),
                                    ("5", "1", None, d(1, 1), "C"), ("6", "1", "FECHADO", d(1, 2), "C")], ROW)
    with monkeypatch.context() as m:
        m.setattr(Published, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.run_update(spark, root, second, AS_OF, KEYS, order)
    assert state(spark, root, schema) == night
    incremental.run_update(spark, root, second, AS_OF, KEYS, order)
    assert incremental.stored_watermark(spark, root, AS_OF) == dt.date(2025, 1, 5)
    # ticket 2 is open again: current, and not in the history any more
    assert state(spark, root, schema) == {
        "current": [("1", "FECHADO", "B", d(2, 10)), ("2", "ABERTO", "A", d(1, 5)), ("3", "FECHADO", "A", d(3, 1))],
        "history": [("5", None, "C", d(1, 1)), ("6", "FECHADO", "C", d(1, 2))], "rejects": [("4", "FECHADO", "A", None)]}
    # closed for good: the watermark moves on, the history takes the last row of each; only new rows are added to it
    third = spark.createDataFrame([("2", "1", "FECHADO", d(1, 5), "B"), ("6", "1", "FECHADO", d(1, 2), "C")], ROW)
    incremental.run_update(spark, root, third, AS_OF, KEYS, order)
    assert state(spark, root, schema)["history"] == [
        ("1", "FECHADO", "B", d(2, 10)), ("2", "FECHADO", "B", d(1, 5)), ("3", "FECHADO", "A", d(3, 1)),
        ("5", None, "C", d(1, 1)), ("6", "FECHADO", "C", d(1, 2))]
    _, last = Published(spark, root).latest()
    assert last["oldest_open"] == AS_OF.isoformat()
    assert spark.read.parquet(last["history"][-1]).count() == 3
    # what no kept version names is gone
    used = set(os.listdir(tmp_path / "tickets" / "data"))
    assert {os.path.basename(f) for f in last["history"]} | {os.path.basename(last["split"])} <= used
    assert Published(spark, root).versions() == [3, 4]


def test_two_writers_of_one_version(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"))
    assert store.latest() == (0, {})
    assert store.publish({"a": 1}, 0) == 1
    with pytest.raises(AlreadyPublished):
        Published(spark, str(tmp_path / "t")).publish({"a": 2}, 0)
    assert store.latest() == (1, {"a": 1})


def test_upsert_stream_writes_only_touched_partitions(spark, tmp_path):
    schema = "SS string, TAREFA string, DATA long, v string"
    batches = [[(str(i), "1", 10, "old") for i in range(40)], [("3", "1", 11, "new"), ("3", "1", 9, "late")],
               [("7", "1", 9, "late"), (None, "1", 1, "null key")], [("3", "1", 11, "zz tie")]]
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "landing" / f"f{n}"))
        for f in (tmp_path / "landing" / f"f{n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))  # the order in which the files arrive
    st = spark.read.parquet(str(tmp_path / "landing" / "f0")).schema
    root, order = str(tmp_path / "target"), ["DATA", "v"]
    args = (spark, str(tmp_path / "landing" / "*"), st, KEYS, order, root)
    written = twin.upsert_stream(*args, str(tmp_path / "ck"), partitions=8)
    assert len(written[0]) > 4 and len(written[1]) == 1 and len(written[2]) in (1, 2) and written[3] == written[1]
    batch = dedup.latest_per_key(spark.read.schema(st).parquet(str(tmp_path / "landing" / "*")), KEYS, [F.col(c) for c in order])
    want = sorted(map(tuple, batch.select(st.names).collect()), key=repr)
    got = lambda: sorted(map(tuple, twin.read_upserted(spark, root, st).select(st.names).collect()), key=repr)
    assert got() == want
    # everything delivered again: the same rows; folders of earlier versions are removed
    twin.upsert_stream(*args, str(tmp_path / "ck2"), partitions=8)
    assert got() == want
    state = Published(spark, root).latest()[1]
    assert len(os.listdir(tmp_path / "target" / "data")) < len(written) + 5 and len(state) <= 8
    # a batch without rows publishes nothing
    before = Published(spark, root).versions()
    assert twin.upsert(Published(spark, root), spark.createDataFrame([], schema), st, KEYS, order, 8) == []
    assert Published(spark, root).versions() == before
