"""Near-duplicates by b-bit MinHash.

Of each document's minima over many hash functions only the low bits are kept, packed to a few words. Bands of whole minima
find candidates; the packed signatures then decide: equal bits are counted and the count corrected for collisions by chance,
J = (E - 2**-b) / (1 - 2**-b). Documents that are similar enough, directly or through others, form a group.

Within a bucket (documents with one band in common) the pairs aren't listed. A bucket of two is a pair. In a larger one a
search visits every document once, comparing it with those not reached yet, and gives the bucket's exact components: a group
of thousands of copies costs one comparison each, no number of partners is capped, and no pair's similarity is decided by
another pair's. A bucket of more than CHUNK members is cut to chunks, and each two chunks meet in a task of their own, so
neither memory nor the work of a task grows with the bucket (the number of such tasks does, with the square of the bucket's
different texts). Exact copies come together before that, by a minimum for each signature: however many they are, they are
rows, never an array.

Defined results. Null and empty texts, texts without letters or digits, and rows with a null doc_id: never in a group. Texts
of fewer words than a shingle: one shingle, the whole text. Repeated rows: rows that share a doc_id are one document, with
the minima of all its rows; drop_near_duplicates() keeps one of those that share the text too. Ties: the least doc_id stays.
Ids are of any type that has an order. Empty tables give no rows. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, exploded_id, fresh, hashed_words, id_type, materialize, mix, range_hashes, slices, typed_id
from .components import connected_components

#: The threshold lies between documents that share a passage (up to about 0.45) and near copies (0.6 and more).
N_HASHES, BITS, BANDS, ROWS, SHINGLE, THRESHOLD = 256, 4, 42, 3, 3, 0.5
CHUNK = 8192


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's runs of `size` words (one run of all words if it has fewer), and each text's first."""
    h, at = hashed_words(texts, fold=True)
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    first = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(at[:-1] - first[:-1], count) + np.arange(first[-1])
    ends = np.minimum(starts + size, np.repeat(at[1:], count))
    return (range_hashes(h, starts, ends) >> np.uint64(32)).astype(np.uint32), first


def minima(texts: list[str], n_hashes: int = N_HASHES, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their minima as rows of 32-bit values)."""
    x, first = shingles(texts, size)
    rows = np.flatnonzero(np.diff(first))
    out = np.empty((len(rows), n_hashes), np.uint32)
    if not len(rows):
        return rows, out
    a, b = _functions(n_hashes)
    block = 1 << 15  # values that stay in the cache while all functions pass over them
    starts = first[rows]
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + block, "right")) - 1)
        if hi >= len(rows) - 1:
            hi = len(rows)
        end = starts[hi] if hi < len(rows) else len(x)
        part, cut = x[starts[lo] : end], starts[lo:hi] - starts[lo]
        y = np.empty_like(part)
        for i in range(n_hashes):
            np.multiply(part, a[i], out=y)
            np.add(y, b[i], out=y)
            out[lo:hi, i] = np.minimum.reduceat(y, cut)
        lo = hi
    return rows, out


def pack(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the scrambled minima, one plane of n/64 words for each bit."""
    low = mix(m.astype(np.uint64))
    planes = [np.packbits(((low >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), axis=1) for i in range(bits)]
    return np.concatenate(planes, axis=1)


def similarity(one: np.ndarray, many: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of a packed signature (bytes) with each of many, corrected for chance collisions."""
    differ = (one ^ many).view(np.uint64).reshape(len(many), bits, -1)
    equal = 1 - np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(1) / (differ.shape[2] * 64)
    chance = 0.5**bits
    return (equal - chance) / (1 - chance)


def bands(m: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of whole minima."""
    h = np.zeros((len(m), n), np.uint64)
    for j in range(rows):
        h = mix(h ^ m[:, j : n * rows : rows].astype(np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_hashes: int = N_HASHES, bits: int = BITS, n_bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, sig, keys) of every document that has words."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch["text"]):
                own, m = minima(texts, n_hashes, size)
                if len(own):
                    packed, keys = pack(m, bits), bands(m, n_bands, rows)
                    width = packed.shape[1]
                    sig = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * width), pa.py_buffer(packed.tobytes())])
                    lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * n_bands, pa.array(keys.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at + own)), sig, lists], ["doc_id", "sig", "keys"])

    return exploded_id(docs, id_col, text_col).where("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {id_type(docs, id_col)}, sig binary, keys array<long>")


def bucket_components(sigs: np.ndarray, threshold: float, bits: int = BITS) -> np.ndarray:
    """For each signature of a bucket the index of the first that it's connected to by pairs at least that similar.

    Each member is compared with those not reached before it, so each is reached once.
    """
    root = np.full(len(sigs), -1)
    left = np.arange(len(sigs))
    while len(left):
        start, left = left[0], left[1:]
        root[start] = start
        queue = [start]
        while queue and len(left):
            near = similarity(sigs[queue.pop()], sigs[left], bits) >= threshold
            queue.extend(left[near])
            root[left[near]] = start
            left = left[~near]
    return root


def cross_components(sigs: np.ndarray, left: np.ndarray, threshold: float, bits: int = BITS) -> np.ndarray:
    """bucket_components() for the pairs of a left signature with another one only."""
    root = np.arange(len(sigs))
    rest = {True: np.flatnonzero(left), False: np.flatnonzero(~left)}
    while len(rest[True]) and len(rest[False]):
        start, rest[True] = rest[True][0], rest[True][1:]
        queue = [start]
        while queue:
            x = queue.pop()
            other = not left[x]
            if len(rest[other]):
                near = similarity(sigs[x], sigs[rest[other]], bits) >= threshold
                queue.extend(rest[other][near])
                root[rest[other][near]] = start
                rest[other] = rest[other][~near]
    return root


def _bytes(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _edges(threshold: float, bits: int):
    """Rows sorted by (key, i, j): works through whole tiles, as many at a time as batches bring."""

    def work(t: pa.Table) -> pa.RecordBatch:
        place = [t[c].to_numpy() for c in ("key", "i", "j")]
        sigs, left = _bytes(t["sig"], len(t)), t["on_left"].to_numpy(zero_copy_only=False).astype(bool)
        cut = np.flatnonzero(np.append(True, np.logical_or.reduce([p[1:] != p[:-1] for p in place])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cut, np.append(cut[1:], len(t))):
            if hi - lo < 2:
                continue
            within = place[1][lo] == place[2][lo]
            r = bucket_components(sigs[lo:hi], threshold, bits) if within else cross_components(sigs[lo:hi], left[lo:hi], threshold, bits)
            far = np.flatnonzero(r != np.arange(hi - lo))
            a.append(lo + r[far])
            b.append(lo + far)
        ids = t["doc_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            last = [batch[c][batch.num_rows - 1] for c in ("key", "i", "j")]
            if kept[0].num_rows and [kept[0][c][0] for c in ("key", "i", "j")] == last:
                continue  # one tile so far
            t = pa.Table.from_batches(kept)
            tail = np.logical_and.reduce([t[c].to_numpy() == x.as_py() for c, x in zip(("key", "i", "j"), last)])
            end = int(np.flatnonzero(tail)[0])  # the last tile may go on
            yield work(t.slice(0, end))
            kept = t.slice(end).to_batches()
        if kept:
            yield work(pa.Table.from_batches(kept))

    return run


def _similar(threshold: float, bits: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                one, many = _bytes(b["x"], b.num_rows), _bytes(b["y"], b.num_rows)
                near = pa.array(np.flatnonzero(similarity(one, many, bits) >= threshold))
                yield pa.RecordBatch.from_arrays([b["a"].take(near), b["b"].take(near)], ["a", "b"])

    return run


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_hashes: int = N_HASHES, bits: int = BITS, n_bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, group_id, keep) of all documents in groups of two or more; group_id is the least doc_id of the group, which stays."""
    kind = id_type(docs, id_col)
    made = materialize(signatures(docs, id_col, text_col, n_hashes, bits, n_bands, rows, size), "signatures")
    # exact copies, and rows of one doc_id, come together by the whole signature first
    same = made.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.first("keys").alias("keys"))
    same = materialize(same, "distinct")
    copies = made.join(same.where("rep <> most").select("sig", F.col("rep").alias("a")), "sig").select("a", F.col("doc_id").alias("b")).where("a <> b")
    key = same.select("rep", F.explode("keys").alias("key"))
    buckets = materialize(key.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("n > 1"), "buckets")
    held = same.select(F.col("rep").alias("doc_id"), "sig")
    pairs = buckets.where("n = 2 and a <> b").select("a", "b").distinct()
    pairs = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")).hint("shuffle_hash"), "a").join(held.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")).hint("shuffle_hash"), "b")
    pairs = pairs.select("a", "b", "x", "y").mapInArrow(_similar(threshold, bits), f"a {kind}, b {kind}")
    member = key.join(buckets.where("n > 2").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("g")), "key").withColumn("c", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    member = member.select("key", F.col("rep").alias("doc_id"), "c", F.explode(tile).alias("t")).select("key", "doc_id", "t.i", "t.j", (F.col("c") == F.col("t.i")).alias("on_left"))
    member = member.join(held.hint("shuffle_hash"), "doc_id").select("key", "i", "j", "on_left", "doc_id", "sig")
    edges = member.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id").mapInArrow(_edges(threshold, bits), f"a {kind}, b {kind}")
    found = connected_components(edges.unionByName(pairs).unionByName(copies))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns; of each group only the document of least doc_id, and of rows that share doc_id and text
    only one (which, if their other columns differ, is open). Rows without a doc_id stay."""
    gone_id, digest = fresh(docs, "__gone_id"), fresh(docs, "__digest")
    own, text = typed_id(docs, id_col), col(docs, text_col).cast("string")
    gone = near_duplicate_groups(docs, id_col, text_col, **options).where("not keep").select(F.col("doc_id").alias(gone_id))
    # ids that come with one text twice: few, or none, and only their rows are looked at again
    twice = docs.select(own.alias(gone_id), F.md5(text).alias("h")).where(f"`{gone_id}` is not null").groupBy(gone_id, "h").agg(F.count("*").alias("n")).where("n > 1")
    twice = materialize(twice.select(gone_id).distinct(), "repeated")
    if twice.isEmpty():
        return docs.join(gone.hint("shuffle_hash"), own == F.col(gone_id), "left_anti")
    gone = materialize(gone, "gone")
    out = docs.join(gone.unionByName(twice).hint("shuffle_hash"), own == F.col(gone_id), "left_anti")
    again = docs.join(twice.hint("shuffle_hash"), own == F.col(gone_id), "left_semi").join(gone.hint("shuffle_hash"), own == F.col(gone_id), "left_anti")
    again = again.withColumn(digest, F.md5(F.coalesce(text, F.lit("")))).dropDuplicates([id_col, digest]).drop(digest)
    return out.unionByName(again.select(*[col(again, c) for c in docs.columns]))
