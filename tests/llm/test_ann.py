import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.llm import ann as A
from loamsift.llm import queries


def frame(spark, ids, vectors):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "a", "d", "shard", "lists", "query", "other", "rank")})


def exact(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        d = np.sqrt(((x.astype(np.float64) - v) ** 2).sum(1))
        order = sorted((float(d[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != i)
        out[int(i)] = order[:k]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["distance"], r["neighbour_id"]))
    return out


@pytest.mark.parametrize("kind", ["clusters", "uniform"])
def test_recall_of_every_row_against_brute_force(spark, kind):
    r = np.random.default_rng(1)
    n, dim = 3000, 24
    x = r.normal(size=(n, dim)).astype(np.float32)
    if kind == "clusters":
        x = x * 0.3 + r.normal(size=(8, dim)).astype(np.float32)[r.integers(0, 8, n)]
    ids = np.arange(n) * 7
    got, want = collected(A.all_neighbours(frame(spark, ids.tolist(), x.tolist()), list_rows=20)), exact(ids, x, 10)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()])
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values()) and recall >= 0.95
    for q, g in got.items():
        assert [d for d, _ in g] == sorted(d for d, _ in g)


def test_recall_of_a_small_scattered_group(spark):
    """Dense clusters hold nearly all vectors; the few between them are found as well."""
    r = np.random.default_rng(5)
    dense = r.normal(size=(5, 16))[r.integers(0, 5, 3800)] + r.normal(size=(3800, 16)) * 0.02
    x = np.concatenate([dense, r.normal(size=(200, 16))]).astype(np.float32)
    got, want = collected(A.all_neighbours(frame(spark, range(4000), x.tolist()))), exact(np.arange(4000), x, 10)
    recall = {q: len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()}
    assert np.mean([recall[i] for i in range(3800)]) >= 0.95 and np.mean([recall[i] for i in range(3800, 4000)]) >= 0.9


def test_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    got, want = collected(A.all_neighbours(df)), exact(ids, x, 10)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()]) >= 0.95


def test_graph_search_against_brute_force(spark):
    r = np.random.default_rng(2)
    c, q = r.normal(size=(900, 16)).astype(np.float32), r.normal(size=(300, 16)).astype(np.float32)
    g = A.build_graph(spark.range(1), c)
    ids, d = g.search(q, 20)
    want = np.argsort(A._squared(q, c), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, want)]) > 0.97
    assert (np.diff(d, axis=1) >= 0).all() and np.allclose(d[:, 0], np.linalg.norm(q - c[ids[:, 0]], axis=1), atol=1e-3)
    assert all(len(set(row)) == 20 for row in ids)


def test_lists_are_balanced(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(2600, 8)) * 0.05, r.normal(size=(400, 8)) * 3]).astype(np.float32)
    vectors, dim = A._clean(frame(spark, range(len(x)), x.tolist()), "vec_id", "embedding")
    c = A.cluster(vectors, dim, 30)
    size = np.bincount(A._squared(x, c).argmin(1), minlength=30)
    assert size.max() < 8 * size.mean()


@pytest.mark.parametrize("kind", ["clusters", "uniform", "grid", "one place", "far away"])
def test_search_of_a_list_is_exact(kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(2500, 6)).astype(np.float32)
    if kind == "clusters":
        x = x * 0.01 + r.normal(size=(9, 6)).astype(np.float32)[r.integers(0, 9, len(x))]
    if kind == "grid":  # many ties
        x = np.unique(r.integers(0, 4, (2500, 6)).astype(np.float32), axis=0)
    if kind == "one place":
        x = np.full_like(x, 3) + (np.arange(len(x))[:, None] % 5 * 1e-3).astype(np.float32)
    if kind == "far away":
        x = (x * 0.01 + r.normal(size=(9, 6))[r.integers(0, 9, len(x))] + 300).astype(np.float32)
    q = np.concatenate([x[:300], r.normal(size=(50, 6)).astype(np.float32)])
    row, col, d = A.nearest(q, x, 11)
    for i in range(len(q)):
        full = np.sqrt(((q[i].astype(np.float64) - x) ** 2).sum(1))
        own = {int(c): e for c, e in zip(col[row == i], d[row == i])}
        assert len(own) == (row == i).sum() and all(own[c] == pytest.approx(full[c]) for c in own)
        assert set(np.flatnonzero(full <= np.sort(full)[10] * (1 + 1e-7))) <= set(own)


def test_full_lists_in_parts_lose_nothing(spark, monkeypatch):
    """Members and queries of a list in parts give what the list as a whole gives; string ids too."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(900, 8)) * 0.02, r.normal(size=(300, 8))]).astype(np.float32)
    df = frame(spark, range(1200), x.tolist())
    whole = collected(A.all_neighbours(df, list_rows=10))
    cut = A._fullness
    monkeypatch.setattr(A, "_fullness", lambda *a: tuple(p + 2 for p in cut(*a)))
    assert collected(A.all_neighbours(df, list_rows=10)) == whole
    named = A.all_neighbours(df.withColumn("vec_id", F.format_string("v%04d", "vec_id")), list_rows=10)
    assert {int(q[1:]): len(g) for q, g in collected(named).items()} == {q: len(g) for q, g in whole.items()}


def test_many_copies_are_one_point(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 4)).astype(np.float32)
    rows = np.concatenate([x, np.repeat(x[:2], 200, 0), x[5:9]])
    ids = r.permutation(len(rows))
    got, want = collected(A.all_neighbours(frame(spark, ids.tolist(), rows.tolist()), list_rows=10, recall=1.0)), exact(ids, rows, 10)
    assert set(got) == set(want)
    assert np.mean([[i for _, i in got[q]] == [i for _, i in w] for q, w in want.items()]) > 0.97


def test_awkward_rows(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(100, None), (None, x[0]), (101, [1.0, 2.0]), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4), (105, []), (7, x[7]), (200, x[3]), (201, x[3])]
    got = collected(A.all_neighbours(frame(spark, [i for i, _ in rows], [v for _, v in rows])))
    ids = np.array([*range(40), 200, 201])
    want = exact(ids, np.array([*x, x[3], x[3]], np.float32), 10)
    assert {q: [i for _, i in g] for q, g in got.items()} == {q: [i for _, i in g] for q, g in want.items()}
    assert got[3][:2] == [(0.0, 200), (0.0, 201)]
    assert A.all_neighbours(frame(spark, [1, 2], [None, None])).collect() == []
    assert A.all_neighbours(frame(spark, [1], [[1.0, 2.0]])).collect() == []
    assert collected(A.all_neighbours(frame(spark, [1, 2], [[1.0], [2.0]]))) == {1: [(1.0, 2)], 2: [(1.0, 1)]}
    same = collected(A.all_neighbours(frame(spark, range(300), [[1.0, 1.0]] * 300)))
    assert len(same) == 300 and same[0] == [(0.0, i) for i in range(1, 11)]


def test_commonest_length_is_the_dimension(spark):
    odd = frame(spark, [0, 1, 2, 3, 4], [[9.0], [0.0, 1.0], [0.0, 2.0], [0.0, 4.0], [1.0, 2.0, 3.0]])
    vectors, dim = A._clean(odd, "vec_id", "embedding")
    assert dim == 2 and sorted(r["id"] for r in vectors.collect()) == [1, 2, 3]
    tied = frame(spark, [0, 1], [[9.0], [0.0, 1.0]])
    assert A._clean(tied, "vec_id", "embedding")[1] == 2 and A._clean(tied.limit(0), "vec_id", "embedding")[1] == 0


def test_queries_are_the_ids_divisible_by_100(spark):
    """The registered query asks for these alone, against all rows."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32)
    got, want = collected(queries.op4_posting_list_ann(spark, folder)), {q: w for q, w in exact(ids, x, 10).items() if q % 100 == 0}
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()]) >= 0.9
    assert any(i % 100 for g in got.values() for _, i in g)


@pytest.mark.parametrize("list_rows", [10, 100])
def test_some_queries_get_what_they_get_among_all(spark, list_rows):
    """Copies too, even where the query is beyond the ids that a result can hold; negative ids and ids of other types."""
    r = np.random.default_rng(10)
    x = r.normal(size=(600, 4)).astype(np.float32)
    rows = np.concatenate([x, np.repeat(x[:3], 200, 0)])
    ids = np.arange(len(rows)) - 400
    df = frame(spark, ids.tolist(), rows.tolist())
    every = collected(A.all_neighbours(df, list_rows=list_rows))
    some = collected(A.all_neighbours(df, list_rows=list_rows, every=100))
    assert some == {q: g for q, g in every.items() if q % 100 == 0} and len(some) == 12
    decimals = df.withColumn("vec_id", F.col("vec_id").cast("decimal(20,0)"))
    assert {int(q) for q in collected(A.all_neighbours(decimals, list_rows=list_rows, every=100))} == set(some)
    named = df.withColumn("vec_id", F.format_string("v%04d", F.col("vec_id") + 400))
    asked = {r[0] for r in named.where("pmod(xxhash64(vec_id), 100) = 0").select("vec_id").collect()}
    assert asked and set(collected(A.all_neighbours(named, list_rows=list_rows, every=100))) == asked
    assert A.all_neighbours(df.where("vec_id % 100 <> 0"), every=100).collect() == []


def test_parts_of_queries_follow_their_number(spark):
    """Queries are cut by how many there are, not by how many rows there are: each further part ships the members again."""
    r = np.random.default_rng(11)
    x = r.normal(size=(4000, 8)).astype(np.float32)
    vectors, dim = A._clean(frame(spark, range(len(x)), x.tolist()), "vec_id", "embedding")
    g = A.build_graph(vectors, x[:8].copy())
    parts = lambda asked: A._fullness(g, vectors, dim, 4000, 4000, asked, 8, 9.0, (2, 1.03), 100)
    (members, many), (same, few) = parts(4000), parts(40)
    assert many.min() > 1 and (few == 1).all() and (members == same).all()
