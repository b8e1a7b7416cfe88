import math
import random

import numpy as np
import pytest

from loamsift.llm import quality as Q


def plain(t):
    w = t.split()
    n, m = len(t), len(w)
    up, let = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    dig = sum(c.isdigit() and not c.isalpha() for c in t)
    sp = sum(c.isspace() for c in t)
    other = n - let - dig - sp
    N, M = max(1, n), max(1, m)
    odd = sum(not (x[-1].isalpha() or x[-1].isdigit()) and x[-1] not in ",.;:" for x in w)
    return [math.log1p(n), math.log1p(m), (n - sp) / M, up / N, dig / N, let / N, sp / N, other / N, t.count("!") / M, len(set(w)) / M, sum(a == b for a, b in zip(w, w[1:])) / M, odd / M, sum(not any(c.isalpha() for c in x) for x in w) / M, math.log1p(m / (t.count("\n") + 1))]


def test_statistics_against_plain_python():
    r = random.Random(1)
    texts = ["", "a", "A!! b%% 12 12\n\nx", *["".join(r.choice("aB1 \n!%,é中") for _ in range(r.randrange(80))) for _ in range(200)]]
    got = Q.statistics(texts)
    assert got.shape == (len(texts), len(Q.STATS))
    for x, t in zip(got, texts):
        assert x[:-1] == pytest.approx(plain(t)), t
    assert (Q.statistics([texts[5]])[0] == got[5]).all()


def test_features_approximate_the_kernel():
    r = np.random.default_rng(2)
    k, d = 4, 20_000
    m = Q.Model(np.zeros(k), np.ones(k), r.normal(size=(k, d)) / 2.0, r.uniform(0, 2 * np.pi, d), np.zeros(d + 1), 0, np.zeros(1), np.zeros(1))
    x = r.normal(size=(20, k))
    z = m.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.04


def test_isotonic_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(30):
        n = r.integers(1, 12)
        s, k = np.sort(r.random(n)), r.integers(1, 5, n).astype(float)
        g = np.floor(k * r.random(n) * 1.2).clip(0, k)
        edges, p = Q.isotonic(s, k, g)
        fit = p[np.searchsorted(edges, s, "right") - 1]
        mean = lambda a, b: g[a:b].sum() / k[a:b].sum()
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert fit == pytest.approx(want)


def test_normal_equations_are_those_of_one_pass(spark):
    stats = Q.statistics_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = Q.fit(stats.repartition(7), labels, n_features=16)
    from pyspark.sql import functions as F

    rows = stats.join(labels, "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(Q.HOLD_OUT)) != 0).collect()
    z, y = m.features(np.array([r["x"] for r in rows])), np.array([r["quality"] for r in rows], float)
    penalty = np.eye(17) * Q.RIDGE
    penalty[-1, -1] = 1e-9
    assert m.beta == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y), abs=1e-6)


def test_held_out_accuracy_and_clean_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in Q.score(d, labels.where("doc_id % 2 = 0")).collect()}
    rows = labels.where("doc_id % 2 = 1").collect()
    right = [got[r["doc_id"]]["keep"] == bool(r["quality"]) for r in rows]
    good = [got[r["doc_id"]]["keep"] for r in rows if r["quality"]]
    assert len(got) == d.count() and np.mean(right) > 0.95 and np.mean(good) > 0.97


def test_awkward_rows(spark, docs):
    texts = ["plain words in a row"] * 5 + ["SHOUT!! MORE!!"] * 5 + [None, "", "w " * 300_000, "plain words in a row"]
    ids = [*range(10), 10, 11, None, 3]
    d = docs(texts, ids=ids)
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)] + [(3, 1), (None, 1), (4, None), (77, 0)], "doc_id long, quality int")
    got = Q.score(d, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["probability"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["keep"] and not by[7]["keep"] and by[0]["score"] == by[1]["score"]
    none = Q.score(d, labels.limit(0)).collect()
    assert len(none) == len(texts) and all(r["keep"] and r["score"] is None for r in none)
    ones = Q.score(d, labels.where("quality = 1")).collect()
    assert all(r["probability"] == 1 for r in ones)
    assert Q.score(d.limit(0), labels).collect() == []


def test_string_ids(spark, docs):
    d = docs([f"Good words number {i}, in a sentence." if i % 2 else "BAD!! %%% ***" for i in range(40)]).selectExpr("concat('d', doc_id) as doc_id", "text")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, quality int")
    got = {r["doc_id"]: r["keep"] for r in Q.score(d, labels).collect()}
    assert got == {f"d{i}": bool(i % 2) for i in range(40)}


def test_scores_between_two_steps():
    """Where no calibrating row lies the probability rises along a line, so a score just below the good ones is nearly as good."""
    b, n, good = np.array([1, 2, 3, 90, 91]), np.array([4.0, 4, 4, 4, 4]), np.array([0.0, 1, 1, 3, 4])
    x, p = Q.curve(b, n, good)
    at = lambda s: np.interp(s, x, p)
    assert at([-5, 1.5, 2, 3.9, 4]) == pytest.approx([0, 0, 0.25, 0.25, 0.25])
    assert at([47, 89, 90, 90.9, 91, 99]) == pytest.approx([0.5, 0.75 - 0.5 / 86, 0.75, 0.75, 1, 1])
    assert (np.diff(at(np.linspace(-1, 95, 999))) >= 0).all()


@pytest.mark.parametrize("kind", ["held out bad", "held out good", "others good"])
def test_rows_held_out_of_one_class(spark, docs, kind):
    """All labelled rows count where those held out, or the others, are of one class."""
    part = {r[0]: r[1] for r in spark.range(200).selectExpr("id", "pmod(xxhash64(id), 5) = 0").collect()}
    held, others = [i for i in part if part[i]][:10], [i for i in part if not part[i]][:10]
    bad = set({"held out bad": held, "held out good": others, "others good": held[::2]}[kind])
    ids = held + others
    d = docs(["BAD!! %%% ***" if i in bad else f"Good words number {i}, in a sentence." for i in ids], ids=ids)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    assert {r["doc_id"]: r["keep"] for r in Q.score(d, labels).collect()} == {i: i not in bad for i in ids}
