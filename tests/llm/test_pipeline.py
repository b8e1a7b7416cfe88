import random

from conftest_llm import words

import corpus_pipeline as P
from loamsift.llm import langid, minhash, mixing, packing, secret_scan


def corpus(docs):
    r = random.Random(1)
    texts = [" ".join(words(i, 120, 3000)) for i in range(60)]
    texts += [texts[0], texts[1] + " more", texts[2], "", None, "!!! 123 ???"]
    texts[5] += " token=0123456789abcdef0123"
    sources = [r.choice(["src0", "src1", "src2"]) for _ in texts]
    langs = ["en"] * 64 + [None, "en"]
    return docs(texts, langs, sources)


def test_stages_in_order_and_columns():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"] and P.ORACLE_SQL is None


def test_each_decision_takes_effect(spark, docs, tmp_path):
    d = corpus(docs)
    columns = d.columns
    at, kept = d, []
    for i, (name, stage) in enumerate(P.STAGES):
        at = stage(spark, at, "")
        if i < len(P.STAGES) - 1:
            assert at.columns == columns
            path = str(tmp_path / name)
            at.write.parquet(path)
            at = spark.read.parquet(path)
            kept.append({r["doc_id"]: r["text"] for r in at.collect()})
    assert set(kept[0]) == set(range(63))
    assert set(kept[1]) == set(range(60))
    assert set(kept[2]) == set(kept[1]) and kept[2][5].endswith("token=<SECRET:assignment>") and all(kept[2][i] == kept[1][i] for i in kept[1] if i != 5)
    assert set(kept[3]) < set(kept[2]) and kept[3]
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    placed = {}
    for b in at.collect():
        assert b["tokens"] <= packing.MAX_TOKENS and b["segments"] <= packing.MAX_SEGMENTS
        for m in b["members"]:
            placed[m["example_id"]] = placed.get(m["example_id"], 0) + m["tokens"]
    assert placed == {i: len(encode(t)) for i, t in kept[3].items()}


def test_run_against_its_parts_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in d.collect()}
    f = langid.fit(d)
    order = sorted(rows)
    ok = langid.classify(f, [rows[i]["text"] or "" for i in order], 0.3, 0.02)[4]
    alive = [i for i, x in zip(order, ok) if x]
    _, m = minhash.minima([rows[i]["text"] for i in alive])
    sig = minhash.pack(m)
    parent = {i: i for i in alive}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = minhash.bands(m)
    for x, i in enumerate(alive):
        for y in range(x):
            if (keys[x] == keys[y]).any() and minhash.similarity(sig[x], sig[y : y + 1])[0] >= minhash.THRESHOLD:
                a, b = find(i), find(alive[y])
                parent[max(a, b)] = min(a, b)
    alive = [i for i in alive if find(i) == i]
    left = secret_scan.redact_live(d.where(d["doc_id"].isin(alive)))
    want = {r["doc_id"]: r["text"] for r in mixing.sample(left, tokens=packing.count_tokens(left["text"])).collect()}
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    got = {}
    for b in P.run(spark, sf).collect():
        for x in b["members"]:
            got[x["example_id"]] = got.get(x["example_id"], 0) + x["tokens"]
    assert got == {i: len(encode(t)) for i, t in want.items()}
