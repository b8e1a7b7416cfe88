import random

import numpy as np
import pytest
from conftest_llm import words

from loamsift.llm import minhash as M
from loamsift.llm.components import connected_components


def jaccard(a, b):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    return len(s(a) & s(b)) / len(s(a) | s(b))


def edited(w, r, share):
    return [f"e{r.randrange(10**6)}" if r.random() < share else x for x in w]


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group_id"], set()).add(r["doc_id"])
        assert r["keep"] == (r["doc_id"] == r["group_id"])
    return sorted(map(sorted, out.values()))


def test_estimate_is_close_to_the_truth():
    r = random.Random(1)
    a = words(1, 500)
    for share in (0.0, 0.02, 0.05, 0.1, 0.3, 1.0):
        b = edited(a, r, share)
        _, m = M.minima([" ".join(a), " ".join(b)])
        p = M.pack(m)
        assert abs(M.similarity(p[0], p[1:])[0] - jaccard(" ".join(a), " ".join(b))) < 0.12


def test_minima_against_brute_force():
    texts = [" ".join(words(i, n)) for i, n in enumerate((1, 2, 3, 40, 4000))] + ["", "...", "Ab, aB! ab"]
    rows, m = M.minima(texts, 16)
    assert rows.tolist() == [0, 1, 2, 3, 4, 7]
    a, b = M._functions(16)
    x, first = M.shingles(texts, 3)
    for k, i in enumerate(rows):
        own = x[first[i] : first[i + 1]].astype(np.uint64)
        assert (m[k] == [int(((own * int(p) + int(q)) & 0xFFFFFFFF).min()) for p, q in zip(a, b)]).all()
    assert (M.minima(["Ab, aB! ab cd"])[1] == M.minima(["ab ab AB cd."])[1]).all()


def test_recall_against_brute_force(docs):
    r = random.Random(2)
    bases = [words(i, r.randrange(30, 300)) for i in range(60)]
    texts = [" ".join(edited(b, r, r.choice([0, 0.01, 0.03, 0.06, 0.09]))) for b in bases for _ in range(3)] + [" ".join(words(1000 + i, 120)) for i in range(60)]
    group = {d: min(g) for g in groups(M.near_duplicate_groups(docs(texts))) for d in g}
    hit = total = 0
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(texts[i], texts[j])
            if s >= 0.5:
                total += 1
                hit += i in group and group[i] == group.get(j)
            elif s < 0.1:
                assert i not in group or group[i] != group.get(j)
    assert total > 100 and hit / total >= 0.97


def test_group_of_thousands(docs):
    r = random.Random(3)
    base = words(1, 200)
    texts = [" ".join(base)] * 1500 + [" ".join(edited(base, r, 0.01)) for _ in range(1500)] + [" ".join(words(9, 100))]
    (g,) = groups(M.near_duplicate_groups(docs(texts)))
    assert g == list(range(3000))


def test_bucket_components_are_exact():
    r = np.random.default_rng(4)
    base = r.integers(0, 256, (12, 128), dtype=np.uint8)
    sigs = base[r.integers(0, 12, 90)].copy()
    for s in sigs:
        s[r.integers(0, 128, 14)] ^= r.integers(0, 256, 14, dtype=np.uint8)
    root = M.bucket_components(sigs, 0.55)
    parent = list(range(len(sigs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sigs)):
        for j in np.flatnonzero(M.similarity(sigs[i], sigs) >= 0.55):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert [find(i) for i in range(len(sigs))] == root.tolist()


def test_awkward_rows(docs):
    t = " ".join(words(1, 50))
    long = " ".join(words(2, 50_000))
    texts = [t, t, None, "", "...", t, t, "one", "One!", long, long + " x", t + " extra"]
    ids = [5, 3, 7, 8, 9, None, 5, 20, 21, 30, 31, 3]
    assert groups(M.near_duplicate_groups(docs(texts, ids=ids))) == [[3, 5], [20, 21], [30, 31]]
    d = docs(texts, ids=ids)
    kept = M.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.select("doc_id").collect()) == [(False, None), *[(True, i) for i in (3, 3, 7, 8, 9, 20, 30)]]  # 3 has two texts
    assert M.near_duplicate_groups(d.limit(0)).collect() == []


def test_repeated_rows_stay_once(docs):
    t, u = " ".join(words(1, 50)), " ".join(words(2, 50))
    d = docs([t] * 5 + [u, u, u, "", "", None, None], ids=[4] * 5 + [2, 9, 9, 1, 1, 6, 6])
    assert sorted(r["doc_id"] for r in M.drop_near_duplicates(d).collect()) == [1, 2, 4, 6]
    assert M.drop_near_duplicates(d).columns == d.columns


def test_string_ids(docs):
    from pyspark.sql import functions as F

    t, u = " ".join(words(1, 50)), " ".join(words(2, 50))
    d = docs([t, t, u, u + " x", "other words", None], ids=[1, 2, 3, 4, 5, None]).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")))
    assert groups(M.near_duplicate_groups(d)) == [["doc-1", "doc-2"], ["doc-3", "doc-4"]]
    assert sorted(str(r["doc_id"]) for r in M.drop_near_duplicates(d).collect()) == ["None", "doc-1", "doc-3", "doc-5"]


def test_documents_that_share_a_passage_stay(docs):
    """A shared quarter isn't a near copy."""
    passage = words(7, 60)
    d = docs([" ".join([*words(100 + i, 90), *passage, *words(200 + i, 90)]) for i in range(20)])
    assert M.near_duplicate_groups(d).collect() == []


def test_chunks_lose_no_link(docs):
    """A bucket in chunks of a few members gives the groups that it gives as a whole."""
    r = random.Random(11)
    bases = [words(i, 80) for i in range(6)]
    texts = [" ".join(edited(r.choice(bases), r, r.choice([0.01, 0.04]))) for _ in range(120)]
    d = docs(texts)
    assert groups(M.near_duplicate_groups(d, chunk=4)) == groups(M.near_duplicate_groups(d)) and len(groups(M.near_duplicate_groups(d))) <= 6


def test_cross_components_against_all_pairs():
    r = np.random.default_rng(6)
    base = r.integers(0, 256, (5, 128), dtype=np.uint8)
    sigs = base[r.integers(0, 5, 60)].copy()
    for s in sigs:
        s[r.integers(0, 128, 12)] ^= r.integers(0, 256, 12, dtype=np.uint8)
    left = r.random(60) < 0.5
    edges = [(i, j) for i in range(60) for j in range(i) if left[i] != left[j] and M.similarity(sigs[i], sigs[j : j + 1])[0] >= 0.55]

    def parts(edges):
        p = list(range(60))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[find(a)] = find(b)
        return [[find(x) == find(y) for y in range(60)] for x in range(60)]

    assert parts(edges) == parts(list(enumerate(M.cross_components(sigs, left, 0.55))))


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(70)] + [(1, 1), (5, None), (2, 3), (2, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
