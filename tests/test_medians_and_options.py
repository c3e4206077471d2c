"""Exact medians by narrowing ranges, merged option counts, label points."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import charts, medians


@pytest.mark.parametrize("bins", [2, 8, 1024])
def test_medians_equal_the_plain_ones(spark, monkeypatch, bins):
    monkeypatch.setattr(medians, "BINS", bins)
    rng = random.Random(bins)
    rows = [("a", 5, rng.gauss(0, 1)) for _ in range(401)]  # one value only; an odd group
    rows += [("b", rng.randrange(10), 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(400)]
    rows += [(None, k % 2, None if k % 3 else 1e308 * rng.choice([-1, 1])) for k in range(200)]
    rows += [("c", 7, 1.5), ("d", 1, 2.0), ("d", 2, 4.0), ("e", None, None), ("f", 3, float("nan")), ("f", 4, 9.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, x double")
    got = {r.k: (r.mn, r.mx) for r in medians.medians(df, ["k"], {"n": "mn", "x": "mx"}).collect()}
    assert "e" not in got

    def plain(values):
        known = sorted(v for v in values if v is not None and v == v)
        return (known[(len(known) - 1) // 2] / 2 + known[len(known) // 2] / 2) if known else None

    for k, found in got.items():
        assert found[0] == plain([r[1] for r in rows if r[0] == k])
        assert found[1] == pytest.approx(plain([r[2] for r in rows if r[0] == k]), rel=1e-12)
    whole = medians.medians(df, [], {"n": "mn"}).collect()
    assert len(whole) == 1 and whole[0].mn == statistics.median(r[1] for r in rows if r[1] is not None)
    assert medians.medians(df.limit(0), ["k"], {"n": "mn"}).count() == 0


def test_medians_of_a_million_keep_tasks_small(spark, monkeypatch):
    df = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("x"))
    seen = []
    plain = medians._holding
    monkeypatch.setattr(medians, "_holding", lambda rows, group, order: (seen.append((rows, order)), plain(rows, group, order))[1])
    assert medians.medians(df, [], {"x": "m"}).first().m == df.agg(F.median("x")).first()[0]
    for rows, order in seen:  # what one task puts in order
        n = rows.groupBy("_key", "_of", "_rank").count().agg(F.max("count")).first()[0]
        assert n <= (1024 if order == "_part" else 20)


def _options(df):
    return {tuple(r) for r in df.collect()}


def test_merged_option_counts_equal_the_full_lists(spark):
    schema = "SS string, MANTENEDOR string, TIPO string, TAGS array<string>"
    night1 = [("1", "A", "x", ["t1", "t2"]), ("2", "B", None, ["t1"]), ("3", "B", "y", None)]
    night2 = [("4", "C", "x", []), ("5", None, "z", ["t3"])]
    changed_from, changed_to = [("2", "B", None, ["t1"]), ("3", "B", "y", None)], [("2", "A", "x", ["t3"]), ("3", "D", "y", ["t2"])]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    count = lambda rows: charts.option_counts(frame(rows))
    counts = count(night1)
    counts = charts.merge_option_counts(counts, count(night2))
    counts = charts.merge_option_counts(counts, count(changed_to), count(changed_from))
    now = frame([night1[0], *night2, *changed_to])
    assert _options(charts.options_of(counts)) == _options(charts.filter_options(now))
    assert _options(counts) == _options(charts.option_counts(now))
    assert ("MANTENEDOR", "B") not in _options(charts.options_of(counts))
    early = charts.merge_option_counts(count([]), retracted=count(night2))  # out of order: gone before it came
    assert not _options(charts.options_of(early))
    assert not _options(charts.merge_option_counts(early, count(night2)))


def test_state_points(spark):
    units = spark.createDataFrame([("SP",)] * 150 + [("RJ",)] * 49 + [("AC",), (None,)], "UF string")
    points = spark.createDataFrame([("SP", "Sao Paulo", -48.5, -22.2), ("AC", "Acre", -70.5, -9.2), ("PR", "Parana", -51.6, -24.6)],
                                   "UF string, NOME string, LON double, LAT double")
    got = {r.uf: r for r in charts.state_points(units, points).collect()}
    assert set(got) == {"SP", "RJ", "AC"}
    assert got["SP"].rotulo == "Sao Paulo 75.0%" and (got["SP"].lon, got["SP"].lat) == (-48.5, -22.2)
    assert got["RJ"].rotulo is None and got["RJ"].lon is None and got["RJ"].quantidade == 49  # no centroid: row, no label
    assert got["AC"].rotulo is None and got["AC"].lon == -70.5  # below 1 %
    with pytest.raises(ValueError):
        charts.state_points(units, points.unionByName(points))
    many = spark.range(charts.MOST_CENTROIDS + 1).selectExpr("string(id) UF", "string(id) NOME", "0D LON", "0D LAT")
    with pytest.raises(ValueError):
        charts.state_points(units, many)
