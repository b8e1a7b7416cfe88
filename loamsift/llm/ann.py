"""Approximate nearest neighbours by balanced posting lists: every row is indexed, every row or one in `every` is a query.

Vectors are clustered to lists of about the square root of `list_rows` times their number, up to a bound of bytes; a vector on a
boundary is replicated to several of them. The centroids are searched by a graph in memory. A query takes the lists whose
centroids are nearly as near as the nearest one, by the ratio of distances. How many lists that takes depends on the data
(near vectors of clustered data share a few lists, those of evenly spread data many), so it is measured, for a wanted recall.

A list is searched in one task, where its members are clustered once more: groups of members that lie beyond the k-th
neighbour found so far, by the triangle inequality, are passed over, so within the lists taken nothing is lost. On clustered
data a query compares with a few groups, so the work grows little faster than the number of rows; vectors that are spread
evenly have no near groups, there any index compares a fixed share of all pairs.

Scale: the centroids and their graph are broadcast, about a row for each list: one for 65 536 vectors (fewer, if they are long)
once there are 40 million. They are fitted on a sample of FIT_ROWS for each list; every vector is placed and searched. Equal
vectors are one point that stands for the k + 1 least of their ids, which is all that a result can hold of them, so copies,
however many, cost one search; it is a query if any of its copies is. Lists that the sample shows to be too full are cut, by
members and by queries, and each two parts meet in a task of their own.

Defined results. Null ids and vectors, vectors of another length than the commonest (of equally common ones the greatest), and those with a null or non-finite
element: left out, as queries and as neighbours. A row is not its own neighbour; rows that share an id are one vector (the least in
the order of arrays). Equal distances: the least id first. Fewer than k others: as many as there are. Ids are of any type that
has an order; queries are those divisible by `every`, or where ids are no numbers those whose hash is. Empty tables, and those
without a query, give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import col, id_codes, id_type, materialize, typed_id

K, LIST_ROWS, MOST_ROWS, LIST_BYTES, ROUNDS = 10, 100, 1 << 16, 1 << 26, 5
REPLICAS, REPLICA_RATIO, BEAM = 2, 1.03, 96
RECALL, SAMPLE, FIT_ROWS, LEAST_FIT = 0.95, 256, 64, 1 << 16
DEGREE, LEAST_LISTS, GROUP, TOGETHER, QUERY_BLOCK = 32, 3, 64, 8, 512


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["v"].to_pylist()), np.float32).reshape(-1, dim)


def _squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1))


@dataclass(frozen=True)
class Graph:
    """Centroids, the neighbours of each (padded with itself), and the centroids where a search may begin."""

    c: np.ndarray
    near: np.ndarray
    gates: np.ndarray

    def search(self, q: np.ndarray, m: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each query the m nearest centroids found, nearest first, and their distances (infinite where there are fewer)."""
        step = max(16, min(1024, (1 << 25) // max(1, len(self.c))))  # bounds the memory of a step
        parts = [self._search(q[i : i + step], m, beam) for i in range(0, len(q), step)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, m), int), np.zeros((0, m)))

    def _search(self, q: np.ndarray, m: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))[:, None]
        beam = max(beam, m)
        norm = (self.c * self.c).sum(1)
        d = _squared(q, self.c[self.gates])
        some = np.argsort(d, 1)[:, : min(8, d.shape[1])]
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf, np.float32)
        ids[:, : some.shape[1]] = self.gates[some]
        dist[:, : some.shape[1]] = np.take_along_axis(d, some, 1)
        open_ = ids >= 0
        seen = np.zeros((n, len(self.c)), bool)
        seen[rows, ids[:, : some.shape[1]]] = True
        qq = (q * q).sum(1)[:, None]
        while open_.any():
            # the four nearest of each query that haven't been expanded
            first = np.argsort(np.where(open_, dist, np.inf), 1)[:, :4]
            use = np.take_along_axis(open_, first, 1)
            np.put_along_axis(open_, first, False, 1)
            nodes = np.take_along_axis(ids, first, 1)
            nxt = np.where(use[:, :, None], self.near[np.where(use, nodes, 0)], -1).reshape(n, -1)
            new = (nxt >= 0) & ~seen[rows, nxt]
            live = new.any(1)
            if not live.any():
                continue
            # a neighbour that comes twice in one step counts once
            order = np.sort(np.where(new, nxt, -1), 1)
            new = (order >= 0) & np.append(np.ones((n, 1), bool), order[:, 1:] != order[:, :-1], 1)
            nxt = np.where(new, order, 0)
            r, k = np.nonzero(new)
            at = nxt[r, k]
            seen[r, at] = True
            far = np.full(nxt.shape, np.inf, np.float32)
            far[r, k] = np.maximum(0, qq[r, 0] - 2 * np.einsum("ij,ij->i", q[r], self.c[at]) + norm[at])
            ids = np.concatenate([ids, np.where(new, nxt, -1)], 1)
            dist = np.concatenate([dist, far], 1)
            open_ = np.concatenate([open_, new], 1)
            best = np.argpartition(dist, beam - 1, 1)[:, :beam]
            ids, dist, open_ = (np.take_along_axis(x, best, 1) for x in (ids, dist, open_))
        order = np.argsort(dist, 1, kind="stable")[:, :m]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))


def neighbours(c: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """Diverse near centroids of the given ones: one that is nearer to a chosen neighbour than to the centroid is skipped
    while others remain."""
    d = _squared(c[rows], c)
    d[np.arange(len(rows)), rows] = np.inf
    m = min(2 * degree, len(c) - 1)
    near = np.argpartition(d, m - 1, 1)[:, :m]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1), 1)
    out = np.empty((len(rows), degree), np.int64)
    for i, (row, cand) in enumerate(zip(rows, near)):
        to = _squared(c[cand], c[cand])
        own = d[i, cand]
        chosen: list[int] = []
        for j in range(m):
            if len(chosen) == degree // 2:
                break
            if not chosen or (to[j, chosen] >= own[j]).all():
                chosen.append(j)
        rest = [j for j in range(m) if j not in set(chosen)]
        order = cand[(chosen + rest)[:degree]]
        out[i, : len(order)], out[i, len(order) :] = order, row
    return out


def build_graph(df: DataFrame, c: np.ndarray, degree: int = DEGREE) -> Graph:
    """The graph of the centroids, made in blocks on the executors."""
    spark = df.sparkSession
    n = len(c)
    gates = np.unique(np.linspace(0, n - 1, max(1, min(n, 4 * int(np.sqrt(n))))).astype(np.int64))
    if n < 2:
        return Graph(c, np.zeros((n, 1), np.int64), gates)
    shared = spark.sparkContext.broadcast(c)
    block = 128

    def run(batches):
        for b in batches:
            for i in b["id"].to_pylist():
                rows = np.arange(i * block, min(n, (i + 1) * block))
                near = neighbours(shared.value, rows, degree)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([x.tobytes() for x in near], pa.binary())], ["i", "near"])

    near = np.empty((n, degree), np.int64)
    blocks = -(-n // block)
    for r in spark.range(0, blocks, 1, min(blocks, 512)).mapInArrow(run, "i long, near binary").toLocalIterator():
        near[r["i"]] = np.frombuffer(r["near"], np.int64)
    return Graph(c, near, gates)


def _clean(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    raw = df.select(typed_id(df, id_col).alias("id"), col(df, vec_col).cast("array<float>").alias("a")).where("id is not null and a is not null and size(a) > 0")
    raw = raw.where(~F.exists("a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    top = raw.groupBy(F.size("a").alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).first()[0]
    dim = top or 0
    one = raw.where(F.size("a") == dim).groupBy("id").agg(F.min("a").alias("a"))

    def run(batches):
        for b in batches:
            v = b["a"].flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * (4 * dim)
            yield pa.RecordBatch.from_arrays([b["id"], pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(v.tobytes())])], ["id", "v"])

    return materialize(one.mapInArrow(run, f"id {id_type(df, id_col)}, v binary"), "vectors"), dim


def cluster(vectors: DataFrame, dim: int, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds over the vectors, begun from those of lowest hashed id. After each round the centroids of
    lists far below the mean move next to those of the fullest lists, which balances them."""
    start = vectors.select("v").orderBy(F.xxhash64("id"), "id").limit(n_lists).collect()
    c = np.stack([np.frombuffer(r[0], np.float32) for r in start])
    rng = np.random.default_rng(3)
    for k in range(rounds):
        g = build_graph(vectors, c)
        shared = vectors.sparkSession.sparkContext.broadcast(g)

        def run(batches, shared=shared):
            for b in batches:
                v = _vectors(b, dim)
                own = shared.value.search(v, 1, 24)[0][:, 0]
                order = np.argsort(own, kind="stable")
                ids, at = np.unique(own[order], return_index=True)
                total = np.add.reduceat(v[order].astype(np.float64), at, axis=0)
                square = np.add.reduceat((v[order].astype(np.float64) ** 2).sum(1), at)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(np.append(at, len(own)))), pa.array([np.append(x, q).tobytes() for x, q in zip(total, square)], pa.binary())], ["i", "n", "s"])

        def add(batches):
            n: dict[int, int] = {}
            s: dict[int, np.ndarray] = {}
            for b in batches:
                for i, k, x in zip(*(b[f].to_pylist() for f in ("i", "n", "s"))):
                    n[i] = n.get(i, 0) + k
                    s[i] = s.get(i, 0) + np.frombuffer(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values())), pa.array([s[i].tobytes() for i in n], pa.binary())], ["i", "n", "s"])

        size, spread = np.zeros(len(c), np.int64), np.zeros(len(c))
        for r in vectors.mapInArrow(run, "i long, n long, s binary").repartition("i").mapInArrow(add, "i long, n long, s binary").toLocalIterator():
            mean = np.frombuffer(r["s"]) / r["n"]
            size[r["i"]], c[r["i"]] = r["n"], mean[:-1]
            spread[r["i"]] = np.sqrt(max(0.0, mean[-1] - (mean[:-1] ** 2).sum()) / dim)
        if k < rounds - 1:
            # a list of so many times the mean is split as often, at the cost of the smallest lists
            share = size / size.mean()
            order = np.argsort(-size, kind="stable")
            rich = np.repeat(order, np.maximum(0, np.floor(share[order] / 1.25).astype(int) - 1 + (share[order] > 1.5).astype(int)))
            poor = np.argsort(size, kind="stable")[: min(len(rich), int((share < 0.4).sum()))]
            for a, b in zip(poor, rich):
                c[a] = c[b] + rng.normal(size=dim) * spread[b] * 0.5
    return c


def replicas(g: Graph, v: np.ndarray, most: int = REPLICAS, ratio: float = REPLICA_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(vector row, list) pairs: the nearest list, and up to `most` whose centroids are within the ratio of its distance."""
    ids, d = g.search(v, most)
    return (lambda r, k: (r, ids[r, k]))(*np.nonzero((ids >= 0) & (d <= d[:, :1] * ratio + 1e-12)))


def probes(g: Graph, q: np.ndarray, most: int, ratio: float, least: int = LEAST_LISTS) -> tuple[np.ndarray, np.ndarray]:
    """(query row, list) pairs after pruning by the distance ratio; the `least` nearest lists stay, for queries on a centroid."""
    ids, d = g.search(q, most, max(BEAM, most + most // 4))
    near = d <= d[:, :1] * ratio + 1e-12
    near[:, :least] = True
    return (lambda r, k: (r, ids[r, k]))(*np.nonzero((ids >= 0) & near))


def nearest_of_sample(vectors: DataFrame, dim: int, k: int, n_queries: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, its k nearest others) of n_queries vectors compared with all vectors. They are drawn by another hash than
    the first centroids, near which the lists would look better than they are."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(n_queries).select("v").collect()
    q = np.stack([np.frombuffer(r["v"], np.float32) for r in rows])
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        best = None
        for b in batches:
            v = _vectors(b, dim)
            d = _squared(q, v)
            i, j = np.nonzero(d <= 1e-4 * (q * q).sum(1)[:, None])
            itself = (q[i] == v[j]).all(1)  # no other vector equals it
            d[i[itself], j[itself]] = np.inf
            m = min(k, len(v))
            near = np.argpartition(d, m - 1, 1)[:, :m]
            own = np.take_along_axis(d, near, 1), v[near]
            best = own if best is None else tuple(np.concatenate(x, 1) for x in zip(best, own))
            if best[0].shape[1] > k:
                at = np.argpartition(best[0], k - 1, 1)[:, :k]
                best = np.take_along_axis(best[0], at, 1), np.take_along_axis(best[1], at[:, :, None], 1)
        if best is not None:
            i, j = np.nonzero(np.isfinite(best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[0][i, j].astype(np.float64)), pa.array([x.tobytes() for x in best[1][i, j]], pa.binary())], ["q", "d", "v"])

    best = vectors.mapInArrow(run, "q long, d double, v binary").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "v"))).where(F.col("r") <= k)
    by: dict[int, list[np.ndarray]] = {}
    for r in best.select("q", "v").collect():  # n_queries * k rows at most
        by.setdefault(r["q"], []).append(np.frombuffer(r["v"], np.float32))
    return [(q[i], np.stack(v)) for i, v in by.items()]


def calibrate(g: Graph, sample: list[tuple[np.ndarray, np.ndarray]], recall: float, most_replicas: int, replica_ratio: float) -> tuple[int, float]:
    """How many lists, and within what ratio of distances, reach the wanted recall on the sample's true neighbours."""
    places, ratios = [], []
    for q, v in sample:
        d = np.sqrt(_squared(q[None], g.c)[0])
        order = np.argsort(d, kind="stable")
        place = np.empty(len(d), np.int64)
        place[order] = np.arange(len(d))
        rows, lists = replicas(g, v, most_replicas, replica_ratio)
        best = np.full(len(v), len(d))
        np.minimum.at(best, rows, place[lists])
        places.append(best)
        ratios.append(d[order[best]] / max(1e-12, d[order[0]]))
    if not places:
        return LEAST_LISTS, 1.0
    share = 1 - (1 - recall) / 2  # what either limit may lose
    at = lambda x: float(np.quantile(np.concatenate(x), share, method="higher"))
    return max(LEAST_LISTS, int(at(places)) + 1), at(ratios)


def halves(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in parts of at most `most`: halved along their widest direction until few are left together."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        x = v[own] - v[own].mean(0)
        axis = x[np.argmax((x * x).sum(1))]
        for _ in range(3):
            axis = x.T @ (x @ axis)
            axis = axis / (np.linalg.norm(axis) + 1e-30)
        order = own[np.argsort(x @ axis, kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def groups_of(v: np.ndarray, size: int = GROUP, rounds: int = 2) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(centres, members, radii) of groups of about `size` vectors: parts by halving, which then settle by Lloyd's rounds."""
    c = np.stack([v[own].mean(0) for own in halves(v, size)]).astype(np.float32)
    for last in (*[False] * rounds, True):
        own = np.concatenate([_squared(v[i : i + 4096], c).argmin(1) for i in range(0, len(v), 4096)])
        order = np.argsort(own, kind="stable")
        ids, at = np.unique(own[order], return_index=True)
        if not last:
            c[ids] = np.add.reduceat(v[order], at, axis=0) / np.diff(np.append(at, len(own)))[:, None]
    members = np.split(order, at[1:])
    radii = np.array([np.sqrt(((v[m].astype(np.float64) - c[i]) ** 2).sum(1).max()) for i, m in zip(ids, members)])
    return c[ids], members, radii


def nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, distance) of each query's k nearest members, and of all that tie with the last. A member that
    equals the query counts too.

    Single precision only sorts out, with room for what it may be off by; it works on vectors less their mean, so that room
    stays small far from the origin. The distances are worked out anew in double precision."""
    mean = v.mean(0, dtype=np.float64)
    qc, vc = ((x - mean).astype(np.float32) for x in (q, v))
    off = 1e-5 * max(1.0, v.shape[1] / 64) ** 0.5
    least = v.shape[1] * (2e-7 * max(np.abs(v).max(), np.abs(q).max() if len(q) else 0)) ** 2 + 1e-35
    centres, members, radii = groups_of(vc)
    to = [vc[m] for m in members]
    size = [(x * x).sum(1) for x in to]
    middle = (centres * centres).sum(1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first_of = np.concatenate([_squared(qc[i : i + 4096], centres).argmin(1) for i in range(0, len(q), 4096)]) if len(q) else np.zeros(0, np.int64)
    near_first = np.argsort(first_of, kind="stable")
    for i in range(0, len(q), QUERY_BLOCK):
        block = near_first[i : i + QUERY_BLOCK]
        x, first = qc[block], first_of[block]
        xx = (x * x).sum(1)
        best = np.full((len(block), k), np.inf, np.float32)
        rows, cols, dist = [], [], []
        d = _squared(x, centres)
        bound = np.sqrt(np.maximum(0, d - off * (xx[:, None] + middle) - least)) * 0.9999 - radii * 1.0001

        def look(groups: list[int], ask: np.ndarray) -> None:
            y, yy, own = (a[groups[0]] if len(groups) == 1 else np.concatenate([a[g] for g in groups]) for a in (to, size, members))
            s = np.maximum(0, xx[ask][:, None] - 2 * x[ask] @ y.T + yy)
            if len(groups) > 1:  # each query has seen its own nearest group
                s[first[ask][:, None] == np.repeat(groups, [len(members[g]) for g in groups])] = np.inf
            every = np.concatenate([best[ask], s], 1)
            best[ask] = np.partition(every, k - 1, 1)[:, :k] if every.shape[1] > k else every
            a, b = np.nonzero((s <= best[ask].max(1)[:, None] * 1.0001 + off * (xx[ask][:, None] + yy) + least) & (s < np.inf))
            rows.append(ask[a])
            cols.append(own[b])
            dist.append(s[a, b] - off * (xx[ask[a]] + yy[b]))

        for g in np.unique(first):
            look([g], np.flatnonzero(first == g))
        bound[np.arange(len(block)), first] = np.inf
        within = lambda b: b <= np.sqrt(best.max(1) + 2 * off * xx + least)[:, None]
        may = within(bound)
        open_ = np.flatnonzero(may.any(0))  # groups that some query of the block can't pass over
        open_ = open_[np.argsort(np.median(d[:, open_], 0), kind="stable")]
        together = TOGETHER if may[:, open_].sum() > 0.5 * len(block) * len(open_) else 1  # where most can't, several at once cost less
        for j in range(0, len(open_), together):
            groups = open_[j : j + together]
            ask = np.flatnonzero(within(bound[:, groups]).any(1))
            if len(ask):
                look(list(groups), ask)
        r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
        keep = s <= best.max(1)[r] * 1.0001 + least
        r, c = r[keep], c[keep]
        out.append((block[r], c, np.sqrt(((q[block[r]].astype(np.float64) - v[c]) ** 2).sum(1))))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _search_list(k: int, dim: int):
    def run(table: pa.Table) -> pa.Table:
        ids, back = id_codes(table["id"])
        query = table["query"].to_numpy()
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(-1, dim)
        asks, members = np.flatnonzero(query), np.flatnonzero(~query)
        a, b, d = ids[:0], ids[:0], np.zeros(0)
        if len(asks) and len(members):
            r, c, d = nearest(v[asks], v[members], min(k + 1, len(members)))  # one more, for the query itself
            a, b = ids[asks[r]], ids[members[c]]
            other = a != b
            a, b, d = a[other], b[other], d[other]
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            begin = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1])[: len(a)], np.arange(len(a)), 0)) if len(a) else a
            best = np.arange(len(a)) - begin < k
            a, b, d = a[best], b[best], d[best]
        return pa.table({"id": back(a).cast(table["id"].type), "other": back(b).cast(table["id"].type), "d": pa.array(d, pa.float64())})

    return run


def _fullness(g: Graph, sample: DataFrame, dim: int, n_sample: int, n: int, asked: int, lists: int, ratio: float, replica: tuple[int, float], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Into how many parts each list's members (n in all) and queries (`asked` in all) are cut, by what the sample says of all."""
    shared = sample.sparkSession.sparkContext.broadcast(g)

    def run(batches):
        for b in batches:
            v = _vectors(b, dim)
            for query, at in ((False, replicas(shared.value, v, *replica)[1]), (True, probes(shared.value, v, lists, ratio)[1])):
                i, k = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array([query] * len(i)), pa.array(k)], ["i", "query", "k"])

    out = np.ones((2, len(g.c)))
    for r in sample.mapInArrow(run, "i long, query boolean, k long").groupBy("i", "query").agg(F.sum("k").alias("k")).toLocalIterator():
        out[int(r["query"]), r["i"]] = max(1, np.ceil(r["k"] / max(1, n_sample) * (asked if r["query"] else n) / (4 * rows)))
    return out[0].astype(np.int64), out[1].astype(np.int64)


def _asks(vectors: DataFrame, every: int) -> Column:
    """Whether an id is a query."""
    number = F.col("id") if isinstance(vectors.schema["id"].dataType, NumericType) else F.xxhash64("id")
    return F.pmod(number, F.lit(every)) == 0 if every > 1 else F.lit(True)


def all_neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, list_rows: int = LIST_ROWS, most_rows: int = MOST_ROWS, rounds: int = ROUNDS, recall: float = RECALL, sample: int = SAMPLE, most_replicas: int = REPLICAS, replica_ratio: float = REPLICA_RATIO, every: int = 1) -> DataFrame:
    """id, neighbour_id, rank, distance: the k nearest others, among all vectors, of every vector whose id is divisible by `every`, by
    Euclidean distance.

    recall: what share of the true neighbours the search is set to find. The number of lists and the pruning ratio follow from
    it: `sample` queries are compared with all vectors, and the lists that hold their true neighbours tell.
    """
    vectors, dim = _clean(df, id_col, vec_col)
    kind, spark = id_type(df, id_col), df.sparkSession
    # equal vectors are one point: the least id stands for it, with as many of the next ones as a result can hold
    few = vectors.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = few.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))
    queries = vectors.where(_asks(vectors, every))
    if every > 1:  # a query may be a copy beyond those that a result can hold, so its point is marked by its vector
        points = points.join(queries.select("v").distinct().withColumn("asks", F.lit(True)), "v", "left")
    points = materialize(points.withColumn("asks", F.coalesce("asks", F.lit(False)) if every > 1 else F.lit(True)), "points")
    n, asked = points.agg(F.count("*"), F.count_if("asks")).first()
    if not asked:
        return spark.createDataFrame([], f"id {kind}, neighbour_id {kind}, rank int, distance double")
    rows = int(max(list_rows, min((n * list_rows) ** 0.5, most_rows, LIST_BYTES // (4 * dim))))
    n_lists = -(-n // rows)
    want = max(LEAST_FIT, FIT_ROWS * n_lists)
    fitted, n_fit = points.select("id", "v"), n
    if n > 1.5 * want:
        fitted = materialize(fitted.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(want / n * (1 << 30))), "fit")
        n_fit = fitted.count()
    c = cluster(fitted, dim, min(n_lists, n_fit), rounds)
    g = build_graph(points, c)
    lists, list_ratio = calibrate(g, nearest_of_sample(points, dim, k, sample), recall, most_replicas, replica_ratio)
    parts = _fullness(g, fitted, dim, n_fit, n, asked, lists, list_ratio, (most_replicas, replica_ratio), rows)
    shared = spark.sparkContext.broadcast((g, *parts))

    def place(batches):
        for b in batches:
            g, member_parts, query_parts = shared.value
            v = _vectors(b, dim)
            salt = b["salt"].to_numpy()
            asks = np.flatnonzero(b["asks"].to_numpy(zero_copy_only=False))
            r, at = probes(g, v[asks], lists, list_ratio)
            for query, (r, at) in ((False, replicas(g, v, most_replicas, replica_ratio)), (True, (asks[r], at))):
                own, other = (query_parts, member_parts) if query else (member_parts, query_parts)
                mine = salt[r] % own[at]
                times = other[at]
                r, at, mine = np.repeat(r, times), np.repeat(at, times), np.repeat(mine, times)
                theirs = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                member, part_of_asks = (theirs, mine) if query else (mine, theirs)
                for i in range(0, len(r), 20_000):
                    part = slice(i, i + 20_000)
                    chosen = pa.array(r[part])
                    yield pa.RecordBatch.from_arrays([pa.array(at[part].astype(np.int64)), pa.array(member[part].astype(np.int64)), pa.array(part_of_asks[part].astype(np.int64)), pa.array(np.full(len(chosen), query)), b["id"].take(chosen), b["v"].take(chosen)], ["list", "member", "asks", "query", "id", "v"])

    sent = points.select("id", "v", "asks", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 30)).alias("salt")).mapInArrow(place, f"list long, member long, asks long, query boolean, id {kind}, v binary")
    spread = max(spark.sparkContext.defaultParallelism, min(2 * n_lists, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a number of its own: a list is few bytes but much work, so tasks aren't to be joined by their size
    found = sent.repartition(spread, "list", "member", "asks").groupBy("list", "member", "asks").applyInArrow(_search_list(k, dim), f"id {kind}, other {kind}, d double")
    best = found.groupBy("id", "other").agg(F.min("d").alias("d"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("d", "other"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    if n < vectors.count():
        best = _expanded(best, points, queries, k)
    return best.select("id", F.col("other").alias("neighbour_id"), "rank", F.round("d", 6).alias("distance"))


def _expanded(best: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """From the neighbours of points those of all queries: each point brings the ids it stands for, and its copies lie at no distance."""
    ids = points.select(F.col("id").alias("other"), F.col("ids"))
    near = best.select("id", "other", "d").unionByName(points.where("asks and size(ids) > 1").select("id", F.col("id").alias("other"), F.lit(0.0).alias("d")))
    near = near.join(ids, "other").select(F.col("id").alias("point"), "d", F.explode("ids").alias("other"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("point").orderBy("d", "other"))).where(F.col("r") <= k + 1).select("point", "d", "other")
    own = queries.join(points.select(F.col("id").alias("point"), "v"), "v").select("id", "point")
    rank = F.row_number().over(W.partitionBy("id").orderBy("d", "other"))
    return own.join(near, "point").where("id <> other").withColumn("rank", rank).where(F.col("rank") <= k)
