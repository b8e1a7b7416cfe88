import hashlib
import random

import numpy as np
import pytest

from loamsift.llm import mixing as X


def test_rake_meets_the_marginals():
    r = np.random.default_rng(1)
    t = r.integers(1, 1000, 60).astype(float)
    m = [np.arange(60) % 3, np.arange(60) // 3 % 4, np.arange(60) // 12]
    goals = [np.array(g) / sum(g) for g in ([3, 2, 1], [1, 1, 1, 5], [4, 1, 1, 1, 2])]
    w = X.rake(t, m, goals, 200)
    for i, g in zip(m, goals):
        assert np.bincount(i, w) == pytest.approx(g, abs=1e-6)


def test_rate_against_bisection():
    r = np.random.default_rng(2)
    for _ in range(50):
        t, q = r.integers(1, 100, 20).astype(float), r.random(20) * 3
        budget = t.sum() * r.uniform(0.05, 0.95)
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.minimum(1, mid * q) * t).sum() < budget else (lo, mid)
        assert X.rate(t, q, budget) == pytest.approx(lo, rel=1e-6)


def test_sample_follows_the_targets(docs):
    r = random.Random(3)
    n = 6000
    sources, langs = [r.choice(["src0"] * 8 + ["src1", "src2"]) for _ in range(n)], [r.choice(["en", "en", "fr"]) for _ in range(n)]
    texts = [" ".join(["w"] * r.randrange(5, 30)) for _ in range(n)]
    d = docs(texts, langs, sources, extra=False)
    rows = X.mixture(d).collect()
    assert len(rows) == n
    total = sum(x["tokens"] for x in rows)
    kept = [x for x in rows if x["kept"]]
    size = sum(x["tokens"] for x in kept)
    assert size / total == pytest.approx(X.BUDGET, rel=0.06)
    en = sum(x["tokens"] for x in kept if x["lang_group"] == "en") / size
    assert en == pytest.approx(0.55 / 0.75, abs=0.03)
    for s in ("src0", "src1", "src2"):
        got = sum(x["tokens"] for x in kept if x["source_group"] == s) / size
        assert got == pytest.approx(1 / 3, abs=0.05)
    ids = {x["doc_id"] for x in kept}
    assert {x["doc_id"] for x in X.sample(d).select("doc_id").collect()} == ids
    for x in rows[:200]:
        u = int(hashlib.md5(f"{x['doc_id']}:{X.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        assert x["kept"] == (u < x["probability"]) or abs(u - x["probability"]) < 1e-5


def test_forms(one):
    texts = ["a | b | c | d", "x\ty\tz\tw", "SOME VERY!! LOUD WORDS", "x### y&&& z$$$ w", "w " * 4000, "plain A B | c", None, "", "NATO and EU; a|b"]
    assert one(X.form_of, texts) == ["tabular", "tabular", "shouted", "symbolic", "long", "prose", None, "prose", "prose"]
    assert one(X.n_tokens, ["", None, "a", "abcd", "abcde", "中文字"]) == [0, 0, 1, 1, 2, 3]


def test_targets_of_every_kind():
    """Finite, defined probabilities, whatever categories lack a target."""
    cells = [("a", "en", "p", 100), ("a", "fr", "p", 50), ("b", "en", "q", 70), ("c", "de", "p", 30)]
    p = lambda *t, **o: {c[:3]: c[3] for c in X.probabilities(cells, list(t), **o)}
    full = p({"a": 1, "b": 1, "c": 1}, {"en": 2, "fr": 1, "de": 1}, {"p": 1, "q": 1}, budget=0.3)
    assert all(0 < x <= 1 for x in full.values())
    some = p({"a": 1, "b": 1}, {"en": 1, "fr": 1, "de": 1}, {"p": 1, "q": 1}, budget=0.3)  # c has none: nor has German text left
    assert some[("c", "de", "p")] == 0 and some[("a", "en", "p")] > 0 and some[("b", "en", "q")] > 0
    assert set(p({"z": 1}, {"en": 1}, {"p": 1}).values()) == {0} and set(p({}, {}, {}).values()) == {0}
    assert p({"a": 1, "z": 5}, {"en": 1, "fr": 1, "xx": 9}, {"p": 1}, budget=0.1)[("a", "en", "p")] > 0
    assert set(p({"a": 1}, {"en": 1}, {"p": 1}, budget=1.0).values()) == {0, 1}
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            p(bad, {"en": 1}, {"p": 1})


def test_without_other_and_by_column(docs):
    d = docs([f"text number {i}" for i in range(60)], ["en", "fr", "xx"] * 20, ["s", "t"] * 30, extra=False).selectExpr("*", "if(doc_id % 2 = 0, 'law', 'art') as topic")
    rows = X.mixture(d, topic_col="topic", source_targets={"s": 1.0, "t": 1.0}, lang_targets={"en": 3.0, "fr": 1.0}, topic_targets={"law": 1.0, "art": 1.0}, budget=0.4).collect()
    assert {x["probability"] for x in rows if x["lang_group"] == X.OTHER} == {0.0} and not any(x["kept"] for x in rows if x["lang_group"] == X.OTHER)
    assert any(x["kept"] for x in rows) and not all(x["kept"] for x in rows) and {x["topic_group"] for x in rows} == {"law", "art"}
    assert X.sample(d, source_targets={"nothing": 1.0}).count() == 0


def test_tokens_of_a_tokenizer_and_text_without_spaces(docs):
    from pyspark.sql import functions as F

    from loamsift.llm import packing

    texts = ["汉字没有空格" * 50, "words with blanks between " * 20, "", None]
    d = docs(texts, extra=False)
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    got = {x["doc_id"]: x["tokens"] for x in X.mixture(d, tokens=packing.count_tokens(F.col("text"))).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    estimate = {x["doc_id"]: x["tokens"] for x in X.mixture(d).collect()}
    assert 0.25 < estimate[0] / got[0] < 4 and 0.25 < estimate[1] / got[1] < 4


def test_string_ids(docs):
    d = docs([f"text number {i}" for i in range(40)], extra=False).selectExpr("concat('d', doc_id) as doc_id", "text", "lang", "source")
    assert {r["doc_id"] for r in X.sample(d).collect()} == {r["doc_id"] for r in X.mixture(d).collect() if r["kept"]}


def test_awkward_rows(docs):
    texts = [None, "", " \n", "one two", "one two", "one two", "w " * 200_000, "a b c"]
    d = docs(texts, [None, "en", "en", None, "en", "en", "xx", "en"], [None, "s", "s", "src0", None, "src1", "src1", "src1"], [0, 1, 2, 3, None, 5, 6, 5])
    rows = X.mixture(d, budget=0.5).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x["tokens"] > 0) == (x["probability"] > 0) and (x["kept"] is False or x["tokens"] > 0)
    assert {x["lang_group"] for x in rows if x["doc_id"] in (0, 3, 6)} == {X.OTHER}
    kept = X.sample(d, budget=0.5)
    assert kept.columns == d.columns
    assert X.sample(d, budget=1.0).count() == sum(x["tokens"] > 0 for x in rows)
    assert X.mixture(d.limit(0)).collect() == [] and X.sample(d.limit(0)).count() == 0
