import random

import numpy as np
from conftest_llm import words

from loamsift.llm import substring_dedup as S


def brute(texts, window=S.WINDOW):
    """Spans by comparing all windows."""
    holders, tokens = {}, {i: (t or "").split() for i, t in texts}
    for i, w in tokens.items():
        for s in range(len(w) - window + 1):
            holders.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = set()
    for i, w in tokens.items():
        hits = [s for s in range(len(w) - window + 1) if len(holders[tuple(w[s : s + window])]) > 1]
        group = []
        for s in [*hits, None]:
            if group and (s is None or s > group[-1] + window):
                own = [holders[tuple(w[g : g + window])] for g in group]
                out.add((i, group[0], group[-1] + window, max(map(len, own)), min(map(min, own))))
                group = []
            group.append(s)
    return out


def rows(df):
    return {(r["doc_id"], r["start_word"], r["end_word"], r["copies"], r["first_doc"]) for r in df.collect()}


def test_shared_passages(docs):
    passage, short, long = words(1, 51), words(2, 49), words(3, 400)
    r = random.Random(0)
    texts = []
    for i in range(40):
        w = words(100 + i, r.randrange(0, 200))
        if i % 4 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        if i % 5 == 0:
            w[0:0] = short
        if i % 9 == 0:
            w += long[r.randrange(100) : 300 + r.randrange(100)]
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], " ".join(["same"] * 300), " ".join(["same"] * 260), " ".join(words(7, 60) * 3)]
    got = rows(S.shared_spans(docs(texts), width=1 << 18))
    assert got == brute(enumerate(texts))
    assert {i for i in range(0, 40, 4)} <= {g[0] for g in got}
    assert len(texts) - 1 not in {g[0] for g in got}  # repeats only within itself


def test_nothing_is_lost_when_the_sketch_is_full(docs):
    texts = [" ".join(words(i % 7, 80) + words(i, 60)) for i in range(30)]
    assert rows(S.shared_spans(docs(texts), width=S.BLOCK)) == rows(S.shared_spans(docs(texts), depth=1, width=S.BLOCK)) == brute(enumerate(texts))


def test_frequent_anchors_by_window(docs, monkeypatch):
    passage = words(1, 70)
    texts = [" ".join(words(50 + i, i % 9) + passage[: 55 + i % 16] + words(90 + i, 30)) for i in range(60)] + [" ".join(["same"] * 120)] * 2 + [" ".join(words(5, 80))] * 2
    d, seen = docs(texts), []
    hot_runs = S._hot_runs
    monkeypatch.setattr(S, "_hot_runs", lambda found: seen.append(found.count()) or hot_runs(found))
    want = brute(enumerate(texts))
    assert rows(S.shared_spans(d, width=S.BLOCK)) == want and not seen
    assert rows(S.shared_spans(d, width=S.BLOCK, hot=20)) == want and seen[0] >= 20  # spread over partitions, no more than 20 in any
    monkeypatch.setattr(S, "MOST_BROADCAST", 0)
    assert rows(S.shared_spans(d, width=S.BLOCK, hot=2)) == want


def test_string_ids(docs):
    p = " ".join(words(1, 60))
    d = docs([p, "x " + p, "short", p]).selectExpr("if(doc_id = 3, null, concat('d', doc_id)) as doc_id", "text")
    assert rows(S.shared_spans(d)) == {("d0", 0, 60, 2, "d0"), ("d1", 1, 61, 2, "d0")}


def test_width_follows_the_bytes():
    assert S.width_for(0) == S.BLOCK and S.width_for(1 << 30) == 1 << 25 and S.width_for(1 << 50) == S.MAX_WIDTH and S.width_for((1 << 30) + 32) == 1 << 26


def test_awkward_rows(docs):
    p = " ".join(words(1, 60))
    long = " ".join(words(5, 60_000))
    texts = [p, None, "", "  \n ", p, "few words", p, p, long + " " + p, long]
    ids = [0, 1, 2, 3, None, 5, 6, 6, 8, 9]
    got = rows(S.shared_spans(docs(texts, ids=ids), width=S.BLOCK))
    assert (0, 0, 60, 3, 0) in got and (6, 0, 60, 3, 0) in got and (9, 0, 60_000, 2, 8) in got
    assert {g[0] for g in got} == {0, 6, 8, 9}
    assert rows(S.shared_spans(docs([p, p], ids=[4, 4]), width=S.BLOCK)) == set()
    assert S.shared_spans(docs([p]).limit(0), width=S.BLOCK).collect() == []


def test_sketch_never_underestimates(spark, docs):
    texts = [" ".join(words(i % 5, 90)) for i in range(20)]
    bits = S.sketch(docs(texts, extra=False).select("doc_id", "text"), S.DEPTH, S.BLOCK)
    text, first, n, off, h, sig = S.anchored_windows(texts)
    counts = dict(zip(*np.unique(h, return_counts=True)))
    repeated = np.array([counts[x] > 1 for x in h])
    assert S.estimated_repeated(bits, h, S.DEPTH, S.BLOCK)[repeated].all()


def test_equal_windows_have_equal_anchors():
    w = words(3, 70)
    a = S.anchored_windows([" ".join(words(1, 33) + w + words(2, 9)), " ".join(w)])
    own = {}
    for t in (0, 1):
        for i, first, n, off, h in zip(*a[:5]):
            if i == t:
                for j in range(n):
                    own.setdefault(t, {})[first + j - (33 if t == 0 else 0)] = (h, off - j)
    assert all(own[0][s] == own[1][s] for s in range(21))
