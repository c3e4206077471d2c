"""The pipeline against brute force, and every SQL text of the subpackage on the smallest tables."""

import os
import re

import pytest

import corpus_pipeline
from fieldlens.llm import mixing, queries
from fieldlens.llm.common import materialize
from tests.llm.conftest import DOC
from tools.compare import duck, rows_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, prose, folder):
    rows = [(k, prose(60, k % 4), ("en", "fr", "de", "es")[k % 4], f"s{k % 5}", 1) for k in range(120)]
    items = [prose(30) for _ in range(3)]
    base, passage = rows[0][1].split(), prose(60)
    rows += [(200, rows[4][1], "en", "s0", 1), (201, " ".join(base[:-1] + ["changed"]), "en", "s0", 1),  # copies
             (202, f"{prose(40)} {passage} {prose(10)}", "en", "s1", 1), (203, f"{prose(30)}\n{passage}", "en", "s1", 1),
             (204, f"{prose(30)} {items[1]} {prose(10)}", "en", "s2", 1), (205, "12 34 !", "en", "s2", 1), (206, None, "en", "s2", None)]
    at = folder(documents=spark.createDataFrame(rows, DOC),
                benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, at), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            gone = {205, 206}
        elif name == "near_duplicates":
            gone = {200, 201}
        elif name == "repeated_passages":
            gone = set()
            kept[203] = kept[203].replace("\n" + passage, "")
        else:
            gone = {204}
        kept = {k: t for k, t in kept.items() if k not in gone}
        assert {r.doc_id: r.text for r in docs.collect()} == kept, name
    last = sorted((r.doc_id, r.copy) for r in corpus_pipeline.mixture(spark, docs, at).collect())
    assert last == sorted((r.doc_id, r.copy) for r in mixing.poisson_replicate(docs).collect())
    assert sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, at).collect()) == last


def test_stages_with_odd_rows_and_empty_tables(spark, odd_docs, no_docs, folder):
    at = folder(benchmark=spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, at)
        assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.count() >= 0, name
        assert out.where("`key` <> 7 or n_words <> 7 or kept_text <> 7").count() == 0, name
        assert stage(spark, no_docs, at).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck(SF).execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns) and got == rows_of(cols, res.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14))
