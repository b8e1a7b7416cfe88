import random
import time

import numpy as np
import pytest

from loamsift.llm import packing as P


def brute(demand, limits):
    """The heuristic, one comparison at a time."""
    share = [[d / m for d, m in zip(row, limits)] for row in demand]
    totals = [sum(c) for c in zip(*share)]
    weight = [t / sum(totals) for t in totals]
    left, bins = list(range(len(share))), []
    while left:
        room, own = [1.0] * len(limits), []
        while True:
            best, score = None, -1.0
            for i in left:
                if all(s <= r + 1e-12 for s, r in zip(share[i], room)):
                    v = sum(s * (w * r) for s, w, r in zip(share[i], weight, room))
                    if v > score + 1e-12:
                        best, score = i, v
            if best is None:
                break
            own.append(best)
            left.remove(best)
            room = [r - s for r, s in zip(room, share[best])]
        bins.append(own)
    return bins


def test_heuristic_against_brute_force():
    r = np.random.default_rng(1)
    limits = np.array([100.0, 5, 60])
    for n in (1, 2, 30, 90):
        t = r.integers(1, 100, n)
        demand = np.stack([t, np.ones(n), np.minimum(60, (t * r.random(n)).astype(int))], 1).astype(float)
        got = P.pack_vectors(demand, limits)
        assert sorted(sum(got, [])) == list(range(n)) and all((demand[b].sum(0) <= limits + 1e-9).all() for b in got)
        want = brute(demand.tolist(), limits.tolist())
        assert len(got) == len(want) and sorted(map(sorted, got)) == sorted(map(sorted, want))


def test_fills_well():
    r = np.random.default_rng(2)
    t = r.integers(20, 900, 2000)
    demand = np.stack([t, np.ones(2000), t // 2], 1).astype(float)
    bins = P.pack_vectors(demand, np.array([4096.0, 64, 4096]))
    assert len(bins) <= np.ceil(t.sum() / 4096) * 1.03


def test_many_tiny_examples_are_quick():
    """A shard of 2^20 tokens in examples of three: each waits in line with those of equal demand."""
    r = np.random.default_rng(3)
    t = r.integers(1, 6, 350_000)
    demand = np.stack([t, np.ones(len(t)), (t * r.random(len(t))).astype(int)], 1).astype(float)
    began = time.perf_counter()
    bins = P.pack_vectors(demand, np.array([4096.0, 16, 3072]))
    assert time.perf_counter() - began < 90 and len(bins) == 350_000 // 16 and sorted(sum(bins, [])) == list(range(350_000))


def test_limits_below_one_are_refused(docs):
    for limits in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            P.pack(P.document_examples(docs(["a b"])), *limits)


def test_string_ids(spark):
    rows = [(f"c{i % 40}", i, "assistant", "word " * (i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    number = df.selectExpr("cast(substr(conv_id, 2) as long) as conv_id", "turn", "role", "text")
    key = lambda out: sum(b["tokens"] for b in out.collect())
    named = P.pack_conversations(df, max_tokens=64, max_loss=64)
    assert named.schema["members"].dataType.elementType["example_id"].dataType.simpleString() == "string"
    assert key(named) == key(P.pack_conversations(number, max_tokens=64, max_loss=64))


def test_pieces():
    assert P.pieces([(10, True)], 4, 4) == [(0, 4, 4), (4, 4, 4), (8, 2, 2)]
    assert P.pieces([(3, False), (5, True), (2, False)], 6, 2) == [(0, 5, 2), (5, 2, 2), (7, 3, 1)]
    assert P.pieces([(0, True)], 4, 4) == [] and P.pieces([], 4, 4) == []
    r = random.Random(3)
    for _ in range(300):
        turns = [(r.randrange(30), r.random() < 0.5) for _ in range(r.randrange(6))]
        a, b = r.randrange(1, 20), r.randrange(1, 20)
        got = P.pieces(turns, a, b)
        assert sum(p[1] for p in got) == sum(n for n, _ in turns) and sum(p[2] for p in got) == sum(n for n, x in turns if x)
        assert all(n <= a and x <= b for _, n, x in got) and [p[0] for p in got] == list(np.cumsum([0, *[p[1] for p in got]])[: len(got)])


def checked(df, tokens, loss, limits):
    """Every token is placed once and all limits hold."""
    seen = {}
    for b in df.collect():
        m = b["members"]
        assert (b["tokens"], b["segments"], b["loss_tokens"]) == (sum(x["tokens"] for x in m), len(m), sum(x["loss_tokens"] for x in m))
        assert b["tokens"] <= limits[0] and b["segments"] <= limits[1] and b["loss_tokens"] <= limits[2]
        for x in m:
            seen.setdefault(x["example_id"], []).append((x["start"], x["tokens"], x["loss_tokens"]))
    for e, own in seen.items():
        own.sort()
        assert [s for s, _, _ in own] == list(np.cumsum([0, *[n for _, n, _ in own]])[: len(own)])
    assert {e: sum(n for _, n, _ in own) for e, own in seen.items()} == tokens
    assert {e: sum(x for _, _, x in own) for e, own in seen.items()} == loss


def test_conversations(spark):
    encode = P.tokenizer(P.TOKENIZER).encode_ordinary
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), "word é " * r.randrange(0, 60)) for c in range(150) for t in range(r.randrange(1, 5))]
    rows += [(900, 0, "assistant", "long " * 9000), (None, 0, "user", "lost"), (901, 0, "user", None), (902, None, "assistant", "no turn"), (903, 0, "user", ""), (rows[0][0], rows[0][1], rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    df = df.withColumns({c: F.lit("x") for c in ("n", "h", "turns", "example_id", "shard")})
    tokens, loss = {}, {}
    for c, _, role, text in rows:
        n = len(encode(text or ""))
        if c is not None:
            tokens[c] = tokens.get(c, 0) + n
            loss[c] = loss.get(c, 0) + n * (role == "assistant")
    tokens = {c: n for c, n in tokens.items() if n}
    checked(P.pack_conversations(df, max_tokens=512, max_segments=8, max_loss=300), tokens, {c: loss[c] for c in tokens}, (512, 8, 300))
    assert P.pack_conversations(df.limit(0)).collect() == []


def test_documents_and_shards(docs):
    encode = P.tokenizer(P.TOKENIZER).encode_ordinary
    r = random.Random(5)
    texts = ["some words here " * r.randrange(1, 80) for _ in range(300)] + [None, "", "x" * 100_000]
    d = docs(texts)
    tokens = {i: len(encode(t)) for i, t in enumerate(texts) if t}
    checked(P.pack_documents(d, max_tokens=400, max_segments=5), tokens, tokens, (400, 5, 400))
    many = P.pack(P.document_examples(d), 400, 5, 400, shard_tokens=5000)
    checked(many, tokens, tokens, (400, 5, 400))
    assert len({b["bin_id"] for b in many.collect()}) == many.count()


@pytest.mark.parametrize("text", ["", "a", "é 中 😀 123 don't", "  \n\n x"])
def test_tokens_round_trip(text):
    t = P.tokenizer(P.TOKENIZER)
    assert t.decode(t.encode_ordinary(text)) == text
