"""Ticket filters and search (F-12)."""

import datetime as dt

from fieldlens.operators import filters

SCHEMA = "TAGS array<string>, STATUS string, MODELO string, CLIENTE string, CHASSI string, INICIO timestamp_ntz, FIM timestamp_ntz"


def f12(spark):
    d = dt.datetime
    return spark.createDataFrame([
        (["TAG1"], "ABERTO", "HELIX", "Cliente A", "123456", d(2025, 1, 1), d(2025, 1, 5)),
        (["TAG2"], "FECHADO", "VISTA", "Cliente B", "234567", d(2025, 2, 1), d(2025, 2, 5)),
        (["TAG1", "TAG2"], "ABERTO", "HELIX", "Cliente C", "345678", d(2025, 3, 1), None),
        (["TAG3"], "FECHADO", "CENTURY", "Cliente D", "456789", d(2025, 4, 1), d(2025, 4, 5)),
    ], SCHEMA)


def test_search(spark):
    df = f12(spark)
    for term, n in [("HELIX", 2), ("helix", 2), ("Cliente", 4), ("nomatch", 0), ("345678", 1), ("", 4)]:
        assert filters.search_any_column(df, term).count() == n, term


def test_in_lists_and_repeatability(spark):
    df = f12(spark)
    assert filters.in_lists(df, {"MODELO": ["HELIX"]}).count() == 2
    assert filters.in_lists(df, {"MODELO": ["VISTA"]}).count() == 1
    assert filters.in_lists(df, {"MODELO": [], "MISSING": ["x"]}).count() == 4
    a = sorted(r["CHASSI"] for r in filters.ticket_filter(df, selections={"MODELO": ["HELIX"]}).collect())
    b = sorted(r["CHASSI"] for r in filters.ticket_filter(df, selections={"MODELO": ["HELIX"]}).collect())
    assert a == b == ["123456", "345678"]


def test_tags_status_dates(spark):
    df = f12(spark)
    assert filters.tags_exact(df, ["TAG2", "TAG1"]).count() == 1
    assert filters.tags_exact(df, ["TAG1"]).count() == 1
    assert filters.by_status(df, "FECHADO").count() == 2
    assert filters.by_status(df, "GERAL").count() == 4
    assert filters.date_window(df, dt.date(2025, 2, 1), dt.date(2025, 4, 30)).count() == 2  # null FIM fails


def test_status_null_counts_as_closed(spark):
    df = spark.createDataFrame([("ABERTO",), (None,), ("FECHADO",)], "STATUS string")
    assert filters.by_status(df, "FECHADO").count() == 2
