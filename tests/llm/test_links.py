"""Operators 5 and 9 against brute force."""

import numpy as np
import pytest

from fieldlens.llm import ngram_join, rp_forest
from fieldlens.llm.common import NULL_KEY, connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 30)] + [(70, 60), (60, 71), (71, 71)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components({n for e in edges for n in e}, edges)
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def near(prose):
    rows = [(k, prose(20 + k % 50)) for k in range(60)]
    base = prose(80).split()
    for k in range(40):  # a large group of near copies, some linked, some not
        w = list(base)
        for j in range(k % 4):
            w[(k * 7 + j * 23) % 80] = f"x{k}{j}"
        rows.append((100 + k, " ".join(w)))
    return rows + [(200, "one two"), (201, "one  two"), (202, "one"), (203, ""), (204, rows[3][1]), (205, rows[3][1] + " end")]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 8])
def test_jaccard_links_and_classes(spark, near, block):
    sets = {k: shingles(t) for k, t in near}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]
             if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    classes = components(keys, links)
    df = ngram_join.jaccard_classes(spark.createDataFrame(near, "doc_id long, text string"), block=block)
    got = {r.key: (r.class_key, r.n_links) for r in df.collect()}
    assert got == {k: (classes[k], sum(k in x for x in links)) for k in keys}


def test_pruning_is_the_posterior():
    from math import comb

    for n in (10, 50, 150):
        m = ngram_join.least_matches(n, 0.8, 1e-6)
        x = (np.arange(200_000) + 0.5) / 200_000
        tail = lambda k: (comb(n, k) * x ** k * (1 - x) ** (n - k))
        chance = lambda k: tail(k)[x >= 0.8].sum() / tail(k).sum()
        assert chance(m) >= 1e-6 and (m == 0 or chance(m - 1) < 1e-6)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = {}
    for r in ngram_join.jaccard_classes(odd_docs).collect():
        got.setdefault(r.key, []).append((r.class_key, r.n_links))
    assert got[1] == got[2] == [(1, 2)] and got[3] == [(3, 1), (3, 1)]
    assert got[4] == [(4, 0)] and got[5] == [(5, 0)] and got[6] == [(6, 0)]
    assert sorted(got[NULL_KEY]) == [(1, 2), (NULL_KEY, 0)]
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, *range(3, 16)]
    assert ngram_join.jaccard_classes(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    for k in range(200):  # near and equal ones
        x[2000 + k] = x[k % 20] + 0.08 * rng.standard_normal(16) * np.linalg.norm(x[k % 20]) / 4
    x[2300:2400] = x[7]
    return x


@pytest.mark.parametrize("block", [rp_forest.BLOCK, 64])
def test_forest_finds_the_links(spark, vectors, block):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.key: (r.n_links, r.component) for r in rp_forest.near_vectors(df, leaf=256, block=block).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert all(got[i][0] <= links[i] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * links.sum()
    whole = components(range(len(vectors)), zip(*map(list, np.nonzero(near))))
    assert np.mean([got[i][1] == whole[i] for i in got]) > 0.95


@pytest.mark.parametrize("cosine", [0.96, 0.99])
def test_a_dense_group_of_many_leaves_keeps_its_links(spark, cosine):
    rng = np.random.default_rng(9)
    noise = rng.standard_normal((3000, 32))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([np.eye(32)[0] * np.sqrt(cosine) + noise * np.sqrt(1 - cosine), rng.standard_normal((1000, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rp_forest.near_vectors(df, leaf=64).selectExpr("sum(n_links)").first()[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = int((x @ x.T >= 0.95).sum()) - len(x)
    assert 0.999 * links <= got <= links


def test_near_rows_without_ids_are_linked(spark, prose, folder):
    text = prose(60)
    docs = spark.createDataFrame([(None, text), (None, text + " end"), (None, prose(50)), (4, text + " tail"), (4, prose(40))],
                                 "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_classes(docs).collect()))
    assert got == sorted([(NULL_KEY, 4, 2)] * 2 + [(4, 4, 2), (NULL_KEY, NULL_KEY, 0), (4, 4, 0)])
    assert ngram_join.keep_one(docs).count() == 3
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rp_forest.embedding_dedup_query(spark, folder(embeddings=vectors)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (0, 1, 0, True), (0, 1, 0, True), (7, 1, 7, True), (7, 1, 7, True)]  # kept: the id is the component's


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [2.0, 0.1]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, rp_forest.near_vectors(df).collect()))
    assert got == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), *[(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10)], (NULL_KEY, 3, 1)])
    assert rp_forest.near_vectors(df.limit(0)).count() == 0
