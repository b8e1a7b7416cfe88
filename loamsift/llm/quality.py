"""Quality scores: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

The features approximate a Gaussian kernel over the standardised statistics. Each partition of labelled rows sums its own
normal equations; the sums are added on executors and a fixed number of them reaches the driver, which solves one small
system. Rows held out of the fit calibrate the scores: counts by score bin, then pool-adjacent-violators, with straight lines
over the scores between two steps, where no such row lies.

Defined results. Null and empty texts: statistics of 0, scored like any other row. Null doc_id: scored, never a training
row. Labels that are null: ignored; repeated labels: each counts. No labels, or only one class: every score is the mean
label (null without any), and `keep` is true where there is nothing to go by. Where the rows held out, or the others, lack one of
two classes, all labelled rows take their place. Ties of scores share one probability. Empty
tables give no rows. Texts are read whole. Ids are of any type; the labels' take that of the documents. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, col, exploded_id, id_type, materialize, mix, range_hashes, slices, words

N_FEATURES, BANDWIDTH, RIDGE, BINS, THRESHOLD, HOLD_OUT = 256, 3.0, 1.0, 2000, 0.5, 5
STATS = ("log_chars", "log_words", "word_length", "upper", "digit", "letter", "space", "other", "bang", "distinct", "repeat", "odd_end", "no_letter", "line_words", "character_entropy")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """1 upper case, 2 other letters, 3 digits, 4 white space, 5 all else."""
    out = np.full(0x110000, 5, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        out[c] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 5
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATS for each text."""
    cp, offsets = codepoints(texts)
    kind = class_table()[cp]
    n = np.diff(offsets) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    counts = [per_text(kind == k) for k in (1, 2, 3, 4, 5)]
    counts[3] = counts[3] - 1  # the line feed after each text
    lines = per_text(cp == 10)
    bang = per_text(cp == 33)
    starts, ends = words(cp, kind != 4)
    at = np.searchsorted(starts, offsets)
    m = np.diff(at)
    h = range_hashes(cp, starts, ends)
    doc = np.repeat(np.arange(len(texts)), m)
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort(mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64((1 << 40) - 1) | (doc.astype(np.uint64) << np.uint64(40)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2), dtype=np.int64)])
    bare = (letters[ends] - letters[starts]) == 0
    odd = kind[ends - 1] == 5 if len(ends) else np.zeros(0, bool)
    comma = np.isin(cp[ends - 1], [44, 46, 59, 58]) if len(ends) else odd
    total = lambda x: np.bincount(doc, x, len(texts))
    N, M = np.maximum(1, n), np.maximum(1, m)
    # entropy of characters: by counts over 64 classes of code points
    b = np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)) * 64 + (cp & 63), minlength=64 * len(texts)).reshape(-1, 64) / (N + 1)[:, None]
    entropy = -(b * np.log(np.where(b > 0, b, 1))).sum(1)
    up, low, dig, sp, oth = counts
    return np.stack([np.log1p(n), np.log1p(m), (n - sp) / M, up / N, dig / N, (up + low) / N, sp / N, oth / N, bang / M, distinct / M, total(same) / M, total(odd & ~comma) / M, total(bare) / M, np.log1p(m / lines), entropy], 1)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for b in batches:
            for at, run_ in slices(b["text"]):
                x = statistics(run_)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(x)), lists], ["doc_id", "x"])

    return exploded_id(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type(docs, id_col)}, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    base: float
    edges: np.ndarray
    p: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.edges, self.p)


def isotonic(score: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending scores: (least score, probability) of each step."""
    steps: list[list[float]] = []
    for s, k, g in zip(score, n, good):
        steps.append([s, k, g])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, k, g = steps.pop()
            steps[-1][1] += k
            steps[-1][2] += g
    return np.array([s[0] for s in steps]), np.array([s[2] / s[1] for s in steps])


def curve(b: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the steps over ascending bins, and the probability there: a step is level from its first bin to the end of its last."""
    first, p = isotonic(b, n, good)
    last = b[np.append(np.searchsorted(b, first[1:]) - 1, len(b) - 1)] + 1
    return np.stack([first, last], 1).ravel(), np.repeat(p, 2)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def _summed(df: DataFrame, arrays, groups: int = 16) -> np.ndarray | None:
    """The sum over partitions of a float vector that `arrays` makes of each batch; at most `groups` vectors reach the driver."""

    def first(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = arrays(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def again(batches):
        total = None
        for b in batches:
            for v in b["v"].to_pylist():
                v = np.frombuffer(v)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    rows = df.mapInArrow(first, "v binary").repartition(groups).mapInArrow(again, "v binary").collect()
    return sum(np.frombuffer(r[0]) for r in rows) if rows else None


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", n_features: int = N_FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, bins: int = BINS, seed: int = 11) -> Model | None:
    """stats: (doc_id, x). All labelled rows count; those whose hashed id falls in one of HOLD_OUT parts only calibrate."""
    own = labels.select(col(labels, id_col).cast(id_type(stats, "doc_id")).alias("doc_id"), col(labels, label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = materialize(stats.join(own, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0), "labelled")
    k = len(STATS)

    def moments(b):
        x = _matrix(b["x"])
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = _summed(rows.select("x"), moments)
    if m is None:
        return None
    mean = m[1 : k + 1] / m[0]
    scale = np.sqrt(np.maximum(m[k + 1 :] / m[0] - mean**2, 0))
    r = np.random.default_rng(seed)
    w = r.normal(size=(k, n_features)) / bandwidth
    model = Model(mean, np.where(scale > 1e-9, scale, 1), w, r.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), 0.0, np.zeros(1), np.zeros(1))
    d = n_features + 1

    def normal(b):
        z, y = model.features(_matrix(b["x"])), b["y"].to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    both = {r["held"] for r in rows.groupBy("held").agg(F.min("y").alias("low"), F.max("y").alias("high")).collect() if r["low"] < r["high"]}
    s = _summed((rows.where("not held") if False in both else rows).select("x", "y"), normal)
    penalty = np.eye(d) * ridge
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(s[: d * d].reshape(d, d) + penalty, s[d * d :])
    model = Model(model.mean, model.scale, model.w, model.b, beta, 0.0, model.edges, model.p)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(model.score(_matrix(b["x"])) * bins).astype(np.int64)), b["y"]], ["bin", "y"])

    held = rows.where("held") if True in both else rows
    # scores lie near 0 to 1, so there are a few thousand bins, however many rows
    table = held.select("x", "y").mapInArrow(scored, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    ends, p = curve(np.array([t[0] for t in table]), np.array([t[1] for t in table], float), np.array([t[2] for t in table], float))
    return Model(model.mean, model.scale, model.w, model.b, beta, 0.0, ends / bins, p)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, score, probability (of good quality), keep: a row for each input row. The texts are read once."""
    stats = materialize(statistics_table(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, **options)
    if model is None:
        return stats.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("keep"))

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b["x"]))
            p = model.probability(s)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.round(s, 6)), pa.array(np.round(p, 6)), pa.array(p >= threshold)], ["doc_id", "score", "probability", "keep"])

    return stats.mapInArrow(run, f"doc_id {id_type(stats, 'doc_id')}, score double, probability double, keep boolean")
