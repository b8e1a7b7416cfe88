import itertools

import numpy as np
import pytest

from loamsift.llm import crf_pii as C


@pytest.fixture(scope="module")
def field():
    return C.train([(s, w, t) for s, _, w, t in C.labelled_sentences(500)], rounds=80)


def found(field, text):
    return [(text[a:b], C.TAGS[t][2:]) for _, a, b, t in zip(*C.spans(field, [text]))]


def plain_viterbi(e, moves, begin):
    score = e[0] + begin
    back = []
    for x in e[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(0))
        score = step.max(0) + x
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_against_one_line_at_a_time():
    r = np.random.default_rng(1)
    L = len(C.TAGS)
    moves, begin = r.normal(size=(L, L)), r.normal(size=L)
    lengths = np.concatenate([r.integers(1, 30, 300), [700, 1, 1, 701]])
    e = r.normal(size=(lengths.sum(), L))
    got = C.viterbi(e, lengths, moves, begin)
    at = 0
    for n in lengths:
        assert got[at : at + n].tolist() == plain_viterbi(e[at : at + n], moves, begin)
        at += n


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(2)
    L = len(C.TAGS)
    moves, begin, e = r.normal(size=(L, L)), r.normal(size=L), r.normal(size=(4, L))
    value = lambda p: begin[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(L), repeat=4), key=value)
    assert tuple(C.viterbi(e, np.array([4]), moves, begin)) == best


def test_training_gradient_raises_the_likelihood():
    rows = [(s, w, t) for s, _, w, t in C.labelled_sentences(60)]
    few, many = C.train(rows, rounds=3), C.train(rows, rounds=60)

    def right(f):
        texts = {}
        for s, w, t in rows:
            texts.setdefault(s, []).append((w, t))
        cp, _, a, b, line = C.tokens([" ".join(w for w, _ in x) for x in texts.values()])
        tags = C.viterbi(f.emissions(C.features(cp, a, b, line)), np.array([len(x) for x in texts.values()]), f.moves, f.begin)
        return np.mean(tags == [C.TAGS.index(t) for x in texts.values() for _, t in x])

    assert right(many) > 0.97 and right(many) >= right(few)


def test_training_against_all_paths():
    """One step of ascent along the gradient of the likelihood, worked out over every path of short sentences."""
    rows = [(0, "me", "O"), (0, "q.22@mail1.example.com", "B-EMAIL"), (1, "x", "O"), (2, "at", "O"), (2, "12.13.14.15", "B-IP"), (2, "now", "odd tag")]
    f = C.train(rows, rounds=1, step=0.1, l2=0.0)
    moves, begin = C.allowed()
    L, sentences = len(C.TAGS), {}
    for s, w, t in rows:
        sentences.setdefault(s, []).append((w, C.TAGS.index(t) if t in C.TAGS else 0))
    grad = np.zeros((L, L))
    for own in sentences.values():
        gold = [t for _, t in own]
        paths = [p for p in itertools.product(range(L), repeat=len(own)) if begin[p[0]] and all(moves[a, b] for a, b in zip(p, p[1:]))]
        for p in paths:  # all weights are 0 at first, so all allowed paths are alike
            for a, b in zip(p, p[1:]):
                grad[a, b] -= 1 / len(paths)
        for a, b in zip(gold, gold[1:]):
            grad[a, b] += 1
    got = np.where(moves, f.moves, 0)
    assert (np.sign(np.round(got, 6)) == np.sign(np.round(np.where(moves, grad, 0), 6))).all()


def test_long_sentence_and_bound(spark):
    rows = [(0, i, "word", "O") for i in range(6000)] + [(s, p, w, t) for s, p, w, t in C.labelled_sentences(300, seed=4) if s > 0]
    f = C.train([(s, w, t) for s, _, w, t in rows], rounds=60)  # padded to the longest it would be 300 times 6000
    assert ("q.22@mail1.example.com", "EMAIL") in found(f, "me q.22@mail1.example.com now")
    table = spark.createDataFrame(rows[:20] + [(1, i, "q.22@mail1.example.com", "B-EMAIL") for i in range(30)], "sentence long, position int, word string, tag string")
    none = C.fit(table, max_rows=40, rounds=20)  # the second sentence doesn't fit as a whole
    assert found(none, "q.22@mail1.example.com") == []


def test_all_outer_signs_are_taken_off(field):
    assert found(field, "me q.22@mail1.example.com.,;:!?%%%%$$$$ now") == [("q.22@mail1.example.com", "EMAIL")] and C.tokens(["!!!!!!!!!"])[3].tolist() == [1]


def test_string_ids(docs, field):
    d = docs(["me q.22@mail1.example.com", "none"]).selectExpr("concat('d', doc_id) as doc_id", "text")
    assert [tuple(r) for r in C.find_pii(d, field).collect()] == [("d0", 3, 25, "EMAIL")]


def test_held_out_sentences(field):
    rows = C.labelled_sentences(400, seed=99)
    texts, want = {}, set()
    for s, _, w, t in rows:
        texts.setdefault(s, []).append((w, t))
    joined = [" ".join(w for w, _ in x) for x in texts.values()]
    got = {(i, joined[i][a:b], C.TAGS[t]) for i, a, b, t in zip(*C.spans(field, joined))}
    for i, x in enumerate(texts.values()):
        j = 0
        while j < len(x):
            if x[j][1].startswith("B-"):
                k = j + 1
                while k < len(x) and x[k][1].startswith("I-"):
                    k += 1
                want.add((i, " ".join(w for w, _ in x[j:k]).rstrip(".,|%&#*$!"), x[j][1]))
                j = k
            else:
                j += 1
    assert len(got & want) / len(want) > 0.96 and len(got & want) / len(got) > 0.96


def test_examples(field):
    t = 'Thon anre ab.12@mail3.example.com, and +1 (988) 555-2485 er 4337166598464399. Or 44.161.181.40### the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in v1.2.3 of 2024'
    assert found(field, t) == [("ab.12@mail3.example.com", "EMAIL"), ("+1 (988) 555-2485", "PHONE"), ("4337166598464399", "CARD"), ("44.161.181.40", "IP")]
    assert found(field, "4111 1111 1111 1111\n1234 dogs") == [("4111 1111 1111 1111", "CARD")]
    assert found(field, "nothing here.\n\nAt all!! *** | A. 12 cats") == []


def test_batch_is_as_one_by_one(field):
    texts = ["", "a b.c@d.org", " \n ", "x", "é 10.0.0.1\nq 555-12-3456.", "w " * 3000 + "12.1.1.9"]
    together = sorted(zip(*(x.tolist() for x in C.spans(field, texts))))
    alone = sorted((i, *s) for i, t in enumerate(texts) for s in zip(*(x.tolist() for x in C.spans(field, [t])[1:])))
    assert together == alone and len(alone) == 4


def test_awkward_rows(spark, docs, field):
    long = "word " * 200_000 + "z.10@mail1.example.com"
    texts, ids = [None, "", "me q.22@mail1.example.com", "me q.22@mail1.example.com", long, "at 12.13.14.15 now"], [0, 1, 2, 2, 4, None]
    got = sorted(((r["doc_id"], r["start"], r["end"], r["label"]) for r in C.find_pii(docs(texts, ids=ids), field).collect()), key=repr)
    assert got == sorted([(2, 3, 25, "EMAIL"), (2, 3, 25, "EMAIL"), (4, 1_000_000, 1_000_022, "EMAIL"), (None, 3, 14, "IP")], key=repr)
    assert C.find_pii(docs(texts).limit(0), field).collect() == []
    nothing = C.fit(C.labelled_table(spark).limit(0))
    assert C.find_pii(docs(texts), nothing).collect() == []


def test_the_data_is_found_and_nothing_else(spark):
    import re

    f = C.fit(C.labelled_table(spark))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {tuple(r) for r in C.find_pii(d, f).collect()}
    want = set()
    for r in d.collect():
        for label, p in {"EMAIL": r"[\w.]+@[\w.]+\w", "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}", "IP": r"\b\d+\.\d+\.\d+\.\d+\b", "CARD": r"\b\d{16}\b"}.items():
            want |= {(r["doc_id"], m.start(), m.end(), label) for m in re.finditer(p, r["text"])}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
