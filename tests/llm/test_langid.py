import random

import numpy as np
import pytest

from loamsift.llm import langid as L

SYLLABLES = {"aa": ["ban", "tor", "mil", "sed"], "bb": ["quo", "che", "ien", "oux"], "cc": ["sch", "ung", "ber", "zei"]}


def text(lang, n, seed=0):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_bitmask_filter_holds_every_gram_and_few_others():
    r = np.random.default_rng(1)
    g = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    langs = np.array(["l%02d" % (i % 70) for i in range(3000)], object)
    f = L.build(g, langs, 4)
    masks = f.probe(g)
    at = {x: i for i, x in enumerate(f.langs)}
    assert len(f.langs) == 70 and all(masks[i, at[x] // 64] >> np.uint64(at[x] % 64) & np.uint64(1) for i, x in enumerate(langs))
    other = f.probe(r.integers(0, 1 << 63, 20000, dtype=np.uint64))
    for x, i in at.items():
        seen = ((other[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        assert abs(seen - f.fp[i]) < 0.002


def test_probe_against_sets():
    g = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    langs = np.array([["aa", "bb"][i % 2] for i in range(len(g))], object)
    f = L.build(g, langs, 4, slots_per_gram=64)
    want = np.array([1 << f.langs.index(x) for x in langs], np.uint64)
    assert (f.probe(g)[:, 0] & want == want).all() and (f.probe(g)[:, 0] == want).mean() > 0.999


def test_grams_stay_within_a_text():
    alone = [L.grams_of([t], 4)[0] for t in ("Ab cd", "ef", "", "12 !", "straße")]
    both, at = L.grams_of(["Ab cd", "ef", "", "12 !", "straße"], 4)
    for i, a in enumerate(alone):
        assert (both[at[i] : at[i + 1]] == a).all()
    assert len(alone[2]) == len(alone[3]) == 0 and (L.grams_of(["aB. CD"], 4)[0] == alone[0]).all()


def test_languages_are_told_apart(docs):
    langs = [x for x in SYLLABLES for _ in range(40)]
    texts = [text(x, 60, i) for i, x in enumerate(langs)]
    labels = list(langs)
    labels[3] = "bb"  # a wrong label
    got = {r["doc_id"]: r for r in L.language_id(docs(texts, labels)).collect()}
    assert all(got[i]["detected"] == x and got[i]["accepted"] for i, x in enumerate(langs)) and got[3]["labelled"] == "bb"


def test_awkward_rows(docs):
    good = [text("aa", 40, i) for i in range(10)] + [text("bb", 40, i) for i in range(10)]
    odd = [None, "", " \n", "123 456 !!!", "zzxyv qkjwp vvbx zzqj " * 20, text("aa", 60_000), good[0]]
    texts, langs = good + odd, ["aa"] * 10 + ["bb"] * 10 + [None, "aa", None, "bb", None, None, "aa"]
    d = docs(texts, langs, ids=[*range(20), 20, None, 22, 23, 24, 25, 0])
    kept = L.keep_identified(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 0, *range(1, 20), 25]
    got = L.language_id(d).collect()
    assert len(got) == len(texts) and all(not r["accepted"] for r in got if r["doc_id"] in (20, 22, 23, 24, None))
    assert L.language_id(d.limit(0)).collect() == [] and L.keep_identified(d.limit(0)).count() == 0
    unlabelled = docs(good, [None] * 20)
    assert not any(r["accepted"] for r in L.language_id(unlabelled).collect())


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    f = L.fit(d.where("doc_id % 2 = 0"))
    rows = d.where("doc_id % 2 = 1").select("lang", L.identify(f, d["text"]).alias("r")).collect()
    assert np.mean([r["lang"] == r["r"]["lang"] for r in rows]) > 0.97 and np.mean([r["r"]["accepted"] for r in rows]) > 0.97


@pytest.mark.parametrize("n", [3, 5])
def test_other_gram_lengths(docs, n):
    langs = [x for x in SYLLABLES for _ in range(10)]
    got = L.language_id(docs([text(x, 50, i) for i, x in enumerate(langs)], langs), n=n).collect()
    assert all(r["detected"] == r["labelled"] for r in got)
