"""Operators 3, 4 and 6: accuracy on held-out rows, and the recursions against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import hmm, language, toxicity
from fieldlens.llm.common import NULL_KEY
from tests.llm.conftest import DOC

LANGS = ("en", "fr", "de", "es")


@pytest.fixture(scope="module")
def tongues(spark, prose):
    rows = [(k, prose(30 + k % 20, k % 4), LANGS[k % 4], f"host{k % 6}", 1) for k in range(400)]
    rows += [(1000 + k, prose(40, k % 4), LANGS[(k + 1) % 4], "host0", 1) for k in range(8)]  # wrongly declared
    rows += [(2000, prose(1, 2)[:2], "de", "host1", 1), (2001, "12 34", "en", "host1", 1)]
    return spark.createDataFrame(rows, DOC)


def test_language(spark, tongues):
    got = {r.key: r for r in language.identify(tongues).collect()}
    assert all(got[k].language == LANGS[k % 4] and got[k].kept for k in range(400))
    assert sum(got[1000 + k].language == LANGS[k % 4] for k in range(8)) >= 7
    assert not got[2001].kept and got[2001].language is None


def test_evidence_beside_the_text_decides_unclear_texts(spark, tongues):
    unclear = spark.createDataFrame([(9000, "zz", "fr", "host3", 2), (9001, "zz", None, None, 2)], DOC)
    got = {r.key: r for r in language.identify(tongues.unionByName(unclear)).collect()}
    assert got[9000].language == "fr" and got[9000].confidence > got[9001].confidence


def test_language_of_addresses_and_parents(spark, tongues):
    rows = tongues.withColumns({"suffix": F.when(F.col("lang") == "de", "de").otherwise("com"), "site": F.col("source")})
    more = spark.createDataFrame([(9000, "zz", None, "new", 2)], DOC).withColumns({"suffix": F.lit("de"), "site": F.lit("new.example")})
    got = language.identify(rows.unionByName(more), suffix=F.col("suffix"), parent=F.col("site"))
    assert got.where("key = 9000").first().language == "de"


def brute_language(rows):
    """Language and confidence of rows of (text, declared, suffix, host, parent), by the formulas of the docstring."""

    def trigrams(text):
        b = text.lower().encode()
        c = [x if 97 <= x <= 122 or x >= 128 else 32 for x in b]
        return [((c[i] << 16 | c[i + 1] << 8 | c[i + 2]) * 2654435761 % 2 ** 32) >> 17
                for i in range(len(c) - 2) if sum(x != 32 for x in c[i: i + 3]) >= 2]

    def shares(logs):
        top = max(logs)
        return [math.exp(x - top) / sum(math.exp(y - top) for y in logs) for x in logs]

    grams = [trigrams(r[0]) for r in rows]
    counts = {name: Counter() for name in LANGS}
    for r, g in zip(rows, grams):
        if r[1] in counts:
            counts[r[1]].update(g)
    sizes = {name: sum(c.values()) + language.BUCKETS / 2 for name, c in counts.items()}
    like = [[min(1, 300 / max(len(g), 1)) / 3 * sum(math.log((counts[name][x] + 0.5) / sizes[name]) for x in g) for name in LANGS]
            for g in grams]
    votes = [[int(s > 0.99 and len(g) >= 30) for s in shares(x)] for x, g in zip(like, grams)]
    total = [sum(v[k] for v in votes) for k in range(4)]
    whole = sum(total)
    of = {}
    for r, v in zip(rows, votes):
        for name, value in enumerate(r[1:], 1):
            if value is not None:
                of[name, value] = [a + b for a, b in zip(of.get((name, value), [0] * 4), v)]
    out = []
    for r, x, own in zip(rows, like, votes):
        logs = []
        for k in range(4):
            at = [of.get((name, r[name]), [0] * 4) for name in range(5)]
            above = (at[4][k] + 10 * (total[k] + 1) / (whole + 4)) / (sum(at[4]) + 10)
            host = [a - b for a, b in zip(at[3], own)] if r[3] is not None else [0] * 4
            log = x[k] + math.log((host[k] + 10 * above) / (sum(host) + 10))
            for name in (1, 2):
                if r[name] is not None:
                    log += math.log((at[name][k] + 10 * (sum(at[name]) + 1) / (whole + 1)) / (total[k] + 10))
            logs.append(log)
        s = shares(logs)
        out.append((LANGS[s.index(max(s))], max(s)))
    return out


def test_language_is_the_brute_force_product(spark, prose):
    rng = random.Random(11)
    rows = []
    for k in range(240):
        lang = rng.randrange(4)
        rows.append((prose(rng.choice([1, 2, 3, 25]), rng.choice([lang, lang, rng.randrange(4)])),
                     rng.choice([LANGS[lang], LANGS[lang], None, "it"]), rng.choice(["com", None, LANGS[lang]]),
                     rng.choice([None, f"h{lang}", "h"]), rng.choice([None, f"p{lang % 2}"])))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                               "doc_id long, text string, lang string, suffix string, source string, parent string")
    got = {r.key: r for r in language.identify(df, suffix=F.col("suffix"), parent=F.col("parent")).collect()}
    for k, (lang, confidence) in enumerate(brute_language(rows)):
        assert got[k].language == lang and got[k].confidence == pytest.approx(confidence, rel=1e-9), k
        assert got[k].kept == (confidence >= language.LEAST_CONFIDENCE)


def test_language_odd_rows(spark, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    kept = Counter((r.key, r.kept) for r in rows)
    assert kept[4, False] == kept[5, False] == kept[6, False] == kept[10, False] == 1 and kept[3, True] == 2
    assert kept[NULL_KEY, False] == 1
    out = language.with_language(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.kept for r in rows)
    assert language.identify(no_docs).count() == 0 and language.with_language(no_docs).count() == 0


@pytest.fixture(scope="module")
def rude(spark, prose):
    rng = random.Random(1)
    stems = ["grumbo", "snarfle", "blortig"]
    rows, labels = [], []
    for k in range(1500):
        words = prose(rng.choice([5, 40, 200])).split()
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "s", "ed", "ing", prose(1)]))
        rows.append((k, " ".join(words), "en", "s", 1))
        if rng.random() < 0.5:
            labels.append((k, 0, int(toxic)))
    return (spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
            {k: t for k, _, t in labels})


def test_toxicity_on_held_out_rows(spark, rude):
    docs, labels, truth = rude
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 1500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [s for t, s in held if t], [s for t, s in held if not t]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert np.mean([s >= 0.7 for s in toxic]) > 0.6 and np.mean([s >= 0.7 for s in clean]) < 0.03


def test_held_out_labels_are_not_read(spark, rude):
    docs, labels, _ = rude
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(docs, turned).collect())


def test_risk_stays_non_negative():
    rng = np.random.default_rng(2)
    positive = [np.array([0, int(rng.integers(1, 50))]) << 32 | 1 for _ in range(50)]
    unlabelled = positive[:5] + [rng.integers(1, 50, 3) << 32 | 1 for _ in range(95)]
    w = toxicity.minimise(positive, unlabelled, 0.05, 50)
    assert w[0] > 2 and np.isfinite(w).all() and abs(w[1:-1]).max() < w[0]


def test_risk_over_all_rows_is_the_brute_force_one(spark, rude):
    docs, labels, _ = rude
    rng = np.random.default_rng(5)
    texts = docs.select("text").unionByName(spark.createDataFrame([("zzq " * 3 + " ".join(f"zzq{k}" for k in range(400)),), ("",)], "text string"))
    confirmed = docs.join(labels.where("toxic = 1"), "doc_id").select("text")
    buckets = lambda texts: toxicity.features(pa.array(texts))[3]
    chosen = np.unique(np.concatenate((buckets(["zzq1"]), rng.choice(buckets([r.text for r in docs.limit(20).collect()]), 2_000))))
    w = rng.normal(0, 0.05, len(chosen) + 1)
    got = toxicity.whole_risk(confirmed, texts, chosen, w, 0.1)
    number = {b: k for k, b in enumerate(chosen.tolist())}

    def rows(df):
        out = np.zeros((df.count(), len(w)))
        for x, r in zip(out, df.collect()):
            _, word, owner, bucket = toxicity.features(pa.array([r.text], pa.string()))
            x[-1] = 1
            for v in word:
                for b in bucket[owner == v].tolist():
                    if b in number:
                        x[number[b]] += 1
        return out

    p, u = rows(confirmed), rows(texts)
    assert u.max() > 255  # a long text's feature counts in full
    odds = lambda x: 1 / (1 + np.exp(-(x @ w)))
    clean = lambda x: -np.log(1 - odds(x)).mean()
    assert np.isclose(got.rest, clean(u) - 0.1 * clean(p))
    assert np.allclose(got.d_rest, odds(u) @ u / len(u) - 0.1 * odds(p) @ p / len(p))
    assert np.allclose(got.d_toxic, 0.1 * (odds(p) - 1) @ p / len(p))


def test_the_plane_of_the_whole_risk_corrects_a_small_draw():
    rng = np.random.default_rng(3)

    def documents(n, toxic):
        return [np.unique(np.concatenate([rng.integers(0, 20, 6), rng.integers(20, 26, 2)] if toxic and rng.random() < 0.9
                                         else [rng.integers(0, 24, 6)])) << 32 | 1 for _ in range(n)]

    positive, unlabelled, prior = documents(200, True), documents(300, True) + documents(5700, False), 0.05

    def risk(w):
        f = [np.array([w[x >> 32].sum() + w[-1] for x in part]) for part in (positive, unlabelled)]
        toxic, clean = [np.log1p(np.exp(-x)).mean() for x in f], [np.log1p(np.exp(x)).mean() for x in f]
        return prior * toxic[0] + max(0, clean[1] - prior * clean[0])

    def whole(w):
        x = [np.zeros((len(part), 27)) for part in (positive, unlabelled)]
        for rows, part in zip(x, (positive, unlabelled)):
            rows[:, -1] = 1
            for row, doc in zip(rows, part):
                row[doc >> 32] = 1
        odds = [1 / (1 + np.exp(-(rows @ w))) for rows in x]
        clean = [-np.log(1 - o).mean() for o in odds]
        return toxicity.Risk(clean[1] - prior * clean[0], odds[1] @ x[1] / len(x[1]) - prior * odds[0] @ x[0] / len(x[0]),
                             prior * (odds[0] - 1) @ x[0] / len(x[0]))

    best = toxicity.minimise(positive, unlabelled, prior, 26)
    drawn = positive, [unlabelled[k] for k in rng.choice(len(unlabelled), 600, replace=False)]
    w = plain = toxicity.minimise(*drawn, prior, 26)
    for _ in range(toxicity.ROUNDS):
        w = toxicity.minimise(*drawn, prior, 26, w, whole(w))
    assert risk(w) - risk(best) < 0.3 * (risk(plain) - risk(best))


def test_confirmed_ids_beyond_the_bound_are_drawn(spark, rude, monkeypatch):
    docs, labels, truth = rude
    monkeypatch.setattr(toxicity, "MOST_CONFIRMED", 30)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    toxic, clean = [scores[k] for k, t in truth.items() if t], [scores[k] for k, t in truth.items() if not t]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.85


def test_toxicity_odd_rows(spark, rude, odd_docs, no_docs):
    docs, labels, _ = rude
    odd = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 0), (5, 1, 0)], labels.schema)
    rows = toxicity.score(docs.unionByName(odd_docs.select(docs.columns)), labels.unionByName(odd)).collect()
    assert len(rows) == 1500 + odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(no_docs, labels).count() == 0


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    first, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    texts = [rng.integers(0, 5, n) for n in (1, 6, 2, 7, 5)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))

    def brute(t):
        return sum(first[p[0]] * emit[t[0], p[0]] * math.prod(move[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], t[1:]))
                   for p in itertools.product(range(3), repeat=len(t)))

    for cut in (2, 3, 512):
        got = hmm.log_likelihoods(np.concatenate(texts), offsets, first, move, emit, cut)
        assert np.allclose(got, [math.log(brute(t)) for t in texts])


def test_expected_counts_are_the_posterior():
    rng = np.random.default_rng(1)
    first, move, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T
    texts = [rng.integers(0, 4, n) for n in (3, 5, 1, 5)]
    start = np.cumsum([0] + [len(t) for t in texts[:-1]])
    begin, moves, emitted, log = hmm.expected_counts(
        np.concatenate(texts), start, np.array([len(t) for t in texts]), first, move, emit)
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    total = 0.0
    for t in texts:
        paths = list(itertools.product(range(2), repeat=len(t)))
        p = np.array([first[q[0]] * emit[t[0], q[0]] * math.prod(move[a, b] * emit[x, b] for a, b, x in zip(q, q[1:], t[1:])) for q in paths])
        total += math.log(p.sum())
        for q, share in zip(paths, p / p.sum()):
            want[0][q[0]] += share
            for a, b in zip(q, q[1:]):
                want[1][a, b] += share
            for x, s in zip(t, q):
                want[2][x, s] += share
    assert math.isclose(log, total) and np.allclose(begin, want[0]) and np.allclose(moves, want[1]) and np.allclose(emitted, want[2])


def test_training_raises_the_likelihood(spark, tongues):
    scores = [hmm.score(tongues, head=500, rounds=n).where("held_out").agg(F.sum("score")).first()[0] for n in (1, 3)]
    assert scores[1] > scores[0]


def test_base_scores_and_a_better_model(spark, tongues, odd_docs):
    docs = tongues.unionByName(odd_docs.select(tongues.columns))
    rows = hmm.score(docs, head=200).collect()
    texts = docs.collect()
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    tokens = lambda t: (t or "").encode().translate(fold).split() + [None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    counts = Counter(w for r in texts if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in texts:
        t = tokens(r.text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[r.doc_id, held(r.doc_id), len(t), sum(counts[w] > 0 for w in t), n, round(base, 5)] += 1
    assert Counter((*r[:5], round(r.base_score, 5)) for r in rows) == want
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_hmm_empty_table(spark, no_docs):
    assert hmm.score(no_docs).count() == 0
