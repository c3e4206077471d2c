"""Relationship matrix (F-6 .. F-9)."""

import datetime as dt

from fieldlens.functions import expr as E
from fieldlens.operators import filters, relationship


def test_f6_quadrants(spark):
    rows = [(20.0, 3.0, 10.0, 7.0), (5.0, 3.0, 10.0, 7.0), (5.0, 10.0, 10.0, 7.0), (20.0, 10.0, 10.0, 7.0),
            (None, 1.0, 10.0, 7.0)]
    df = spark.createDataFrame(rows, "v double, a double, vc double, ac double")
    assert [r[0] for r in df.select(E.relationship_score("v", "a", "vc", "ac")).collect()] == [1, 2, 3, 4, 3]


def _tickets(spark, spec):
    rows, n = [], 0
    for maint, count, aging, month in spec:
        for _ in range(count):
            n += 1
            rows.append((str(n), maint, dt.datetime(2025, month, 1), aging))
    return spark.createDataFrame(rows, "SS string, MANTENEDOR string, INICIO timestamp_ntz, AGING int")


def test_f7_trailing_six_months(spark):
    rows = [(str(i), "M", dt.datetime(2025, i, 1), 3) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "SS string, MANTENEDOR string, INICIO timestamp_ntz, AGING int")
    out = filters.trailing_months(relationship.prepare_source(df, dt.date(2025, 9, 1)), 6)
    dates = [r[0] for r in out.select("DATA_BASE").collect()]
    assert min(dates) >= dt.datetime(2025, 2, 1) and max(dates) == dt.datetime(2025, 8, 1)


def test_f8_matrix(spark):
    df = _tickets(spark, [("SAW_A", 10, 2, 1), ("SAW_B", 2, 2, 1), ("SAW_C", 2, 12, 1), ("SAW_D", 10, 12, 1)])
    m = {r["MANTENEDOR"]: r for r in relationship.matrix(relationship.prepare_source(df, dt.date(2025, 2, 1))).collect()}
    assert m["SAW_A"]["VOLUME_CORTE"] == 6.0 and m["SAW_A"]["AGING_CORTE"] == 7.0
    assert [m[k]["SCORE"] for k in ("SAW_A", "SAW_B", "SAW_C", "SAW_D")] == [1, 2, 3, 4]


def test_f9_monthly(spark):
    df = _tickets(spark, [("A", 10, 2, 1), ("B", 2, 12, 1), ("A", 2, 2, 2), ("B", 10, 12, 2)])
    out = relationship.monthly_scores(relationship.prepare_source(df, dt.date(2025, 3, 1))).collect()
    s = {(r["ANO_MES"].month, r["MANTENEDOR"]): r["SCORE"] for r in out}
    assert s == {(1, "A"): 1, (1, "B"): 3, (2, "A"): 2, (2, "B"): 4}


def test_points_spread(spark):
    df = _tickets(spark, [("A", 2, 2, 1), ("B", 2, 2, 1), ("C", 5, 9, 1)])
    pts = {r["MANTENEDOR"]: r for r in relationship.plot_points(
        relationship.matrix(relationship.prepare_source(df, dt.date(2025, 2, 1)))).collect()}
    assert pts["A"]["DUP_COUNT"] == 2 and pts["A"]["VOLUME_PLOT"] < pts["B"]["VOLUME_PLOT"]
    assert pts["C"]["VOLUME_PLOT"] == 5.0


def test_fallback_only_when_no_aging(spark):
    d = dt.datetime
    rows = [("1", "M", d(2025, 1, 1), d(2025, 1, 4), None), ("2", "M", d(2025, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "SS string, MANTENEDOR string, INICIO timestamp_ntz, FIM timestamp_ntz, AGING int")
    cand = relationship.prepare_candidates(df, dt.date(2025, 1, 11))
    m = relationship.matrix(cand).first()
    # no recorded aging at all: FIM (or as_of) minus start -> 3 and 10
    assert m["VOLUME"] == 2 and m["AGING_MEDIO_DIAS"] == 6.5
    assert sorted(r["AGING_NUM"] for r in relationship.resolve(cand).collect()) == [3.0, 10.0]
    df2 = spark.createDataFrame(rows[:1] + [("2", "M", d(2025, 1, 1), None, 8)],
                                "SS string, MANTENEDOR string, INICIO timestamp_ntz, FIM timestamp_ntz, AGING int")
    m2 = relationship.matrix(relationship.prepare_candidates(df2, dt.date(2025, 1, 11))).first()
    # some aging recorded: only those rows count
    assert m2["VOLUME"] == 1 and m2["AGING_MEDIO_DIAS"] == 8.0
