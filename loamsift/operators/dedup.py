"""Exact dedup by content hash, and an explicit operator for similar pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import calculate_hash

BINARY_EXTENSIONS = (".bin", ".dll", ".dylib", ".exe", ".so")
STRATEGIES = ("newest", "oldest", "first", "last")


def settings(config: dict | None) -> tuple[str, float, int]:
    """(algorithm, similarity threshold, least size); what is invalid falls back to sha256, 0.95 and 100."""
    c = config or {}
    algorithm = c.get("hash_algorithm", "sha256")
    threshold, least = c.get("similarity_threshold", 0.95), c.get("min_file_size", 100)
    return algorithm if algorithm in ("md5", "sha1", "sha256", "sha512") else "sha256", float(threshold) if isinstance(threshold, (int, float)) and 0 <= threshold <= 1 else 0.95, int(least) if isinstance(least, int) and least >= 0 else 100


def eligible(records: DataFrame, min_size: int = 100) -> Column:
    ok = (F.coalesce("content", F.lit("")) != "") & (F.octet_length("content") >= min_size)
    if "is_binary" in records.columns:
        ok = ok & ~F.coalesce("is_binary", F.lit(False))
    if "extension" in records.columns:
        ok = ok & ~F.lower(F.coalesce("extension", F.lit(""))).isin(*BINARY_EXTENSIONS)
    return ok


def _hashed(records: DataFrame, algorithm: str, min_size: int) -> DataFrame:
    return records.where(eligible(records, min_size)).withColumns({"hash": calculate_hash(F.col("content"), algorithm), "size": F.octet_length("content").cast("long")})


def duplicate_groups(records: DataFrame, algorithm: str = "sha256", min_size: int = 100) -> DataFrame:
    """hash, count, size of every group of two or more. Only hashes are shuffled."""
    return _hashed(records, algorithm, min_size).groupBy("hash").agg(F.count("*").alias("count"), F.first("size").alias("size")).where("count > 1")


def duplicate_list(records: DataFrame, algorithm: str = "sha256", min_size: int = 100) -> DataFrame:
    """hash, count, size, path, modified_time: a row for each file of a group of two or more, however many copies there are."""
    own = _hashed(records, algorithm, min_size).select("hash", "path", "modified_time")
    return own.join(duplicate_groups(records, algorithm, min_size), "hash").select("hash", "count", "size", "path", "modified_time")


def duplicate_report(records: DataFrame, algorithm: str = "sha256", min_size: int = 100) -> DataFrame:
    """One row of totals: files in groups (all input files if there is no group), groups, bytes that one of each group would save."""
    per = _hashed(records, algorithm, min_size).groupBy("hash").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    all_rows = records.agg(F.count("*").alias("all_files"))
    g = per.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("size") * (F.col("n") - 1))), F.lit(0)).alias("total_duplicate_size"))
    checked = F.when(F.col("duplicate_groups") > 0, F.col("members")).otherwise(F.col("all_files"))
    return g.crossJoin(all_rows).select(checked.alias("total_files_checked"), "duplicate_groups", F.col("duplicate_groups").alias("similar_groups"), "total_duplicate_size", F.col("members").alias("files_with_duplicates"), F.lit(0).cast("long").alias("unique_files"))


def marked(records: DataFrame, strategy: str = "newest", algorithm: str = "sha256", min_size: int = 100, order_col: str | tuple[str, ...] = "ord") -> DataFrame:
    """Every record with deduplication_status (kept or removed) and deduplication_reason. Ineligible ones are kept.

    newest and oldest go by modified_time (none counts as 0), first and last by order_col, one column or several, which also
    break ties. Records that agree in content, time and order are told apart by number, so of each content exactly one stays.
    An unknown strategy means newest.

    The one to stay is found by a minimum for each hash, which combines before the shuffle, so a content that a third of all
    records share is no burden; records then meet it by hash and order, not by hash alone.
    """
    by = [order_col] if isinstance(order_col, str) else list(order_col)
    has_time = "modified_time" in records.columns
    time = F.coalesce(F.col("modified_time").cast("double"), F.lit(0.0)) if has_time else F.lit(0.0)
    hashed = records.withColumn("__hash", F.when(eligible(records, min_size), calculate_hash(F.col("content"), algorithm))).withColumn("__time", time)
    keys = ["__time", *by]
    # how many records agree in all of that: one, save for repeated records
    slim = hashed.where("__hash is not null").groupBy("__hash", *keys).agg(F.count("*").alias("__ties"))
    value = F.struct(*keys, "__ties")
    if strategy in ("first", "last"):
        best = (F.min_by if strategy == "first" else F.max_by)(value, F.struct(*by, "__time"))
    else:
        best = F.min_by(value, F.struct(F.col("__time") if strategy == "oldest" else -F.col("__time"), *by))
    stays = slim.groupBy("__hash").agg(best.alias("b")).select(F.col("__hash").alias("__h"), *[F.col(f"b.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("b.__ties").alias("__n"))
    same = hashed["__hash"] == stays["__h"]
    for i, k in enumerate(keys):
        same = same & hashed[k].eqNullSafe(stays[f"__k{i}"])
    met = hashed.join(stays, same, "left").withColumn("__n", F.when(F.col("__hash").isNull(), 1).otherwise(F.coalesce("__n", F.lit(0))))
    # only records that are repeated as a whole are numbered
    number = F.row_number().over(W.partitionBy("__hash", *keys).orderBy(F.lit(1)))
    single = met.where("__n < 2").withColumn("__kept", F.col("__n") == 1)
    repeated = met.where("__n > 1").withColumn("__kept", number == 1)
    out = single.unionByName(repeated)
    kept = F.col("__kept")
    new = {"deduplication_status": F.when(kept, "kept").otherwise("removed"), "deduplication_reason": F.when(kept, "unique_or_selected").otherwise("duplicate_content")}
    return out.withColumns(new).select(*records.columns, *new)


def deduplicate(records: DataFrame, strategy: str = "newest", algorithm: str = "sha256", min_size: int = 100, order_col: str | tuple[str, ...] = "ord") -> DataFrame:
    return marked(records, strategy, algorithm, min_size, order_col).where("deduplication_status = 'kept'")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one number for each row."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _agreeing(a: str, b: str) -> int:
    """How many characters a and b have in common from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def similarity(a: str, b: str) -> float:
    if a == b or not (a and b):
        return float(a == b)
    head = _agreeing(a, b)  # what both begin and end with is part of a longest common subsequence
    x, y = a[head:], b[head:]
    tail = _agreeing(x[::-1], y[::-1])
    return (head + tail + lcs_length(x[: len(x) - tail], y[: len(y) - tail])) / max(len(a), len(b))


def _apart(a: str, b: str, over_a: int, over_b: int) -> bool:
    """Whether already the first third of a leaves more than over_a characters over. over_b: the most that b may leave over."""
    k = len(a) // 3
    return k > over_a and lcs_length(a[:k], b[: k + over_b]) < k - over_a


#: Bytes of texts and signatures of a chunk, and of one signature besides its text.
CHUNK, SIGNATURE = 24_000_000, 1000


def _hashed_runs(text: str, size: int) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = np.zeros(max(0, len(c) - size + 1), np.uint32)
    for k in range(size):
        h = (h ^ c[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def _counts(texts: list[str], places: int = 64) -> np.ndarray:
    """How often each text has each character, by hash to `places` (a power of two)."""
    out = np.zeros((len(texts), places), np.int32)
    for row, t in zip(out, texts):
        row[:] = np.bincount(_hashed_runs(t, 1) & np.uint32(places - 1), minlength=places)
    return out


def _sets(texts: list[str], size: int, places: int) -> np.ndarray:
    """Each text's runs of `size` characters as a set of bits, by hash to `places` (a power of two) of the run and of how often it came before."""
    out = np.zeros((len(texts), places // 64), np.uint64)
    for row, t in zip(out, texts):
        bits = np.zeros(places, np.uint8)
        h = np.sort(_hashed_runs(t, size))
        at = np.arange(len(h), dtype=np.uint32)
        again = at - np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[: len(h)], at, np.uint32(0)))
        h = (h + again * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
        bits[(h ^ h >> np.uint32(15)) & np.uint32(places - 1)] = 1
        row[:] = np.packbits(bits).view(np.uint64)
    return out


def _share_runs(a: str, b: str, over: int, size: int = 7) -> bool:
    """Whether a and b may leave `over` characters over, by longer runs and roomier sets than are kept for all texts: these tell
    texts of the same few words or signs apart, before the subsequence has to."""
    one, other = _sets([a, b], size, 1 << min(24, max(6, (32 * len(a)).bit_length())))
    return int(np.bitwise_count(one ^ other).sum(dtype=np.int64)) <= (2 * size - 1) * over + 2 * size - 2


def reaching(texts: list[str], left: np.ndarray, within: bool, threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of all pairs of different texts that reach the threshold: left ones with others and, if within, each other.

    A common subsequence as long as wanted leaves at most `over` characters of both texts over. Then their counts of
    characters differ by that at most, and their runs of five by nine times that: a character left over breaks five runs of its
    own text and four of the other; by the same count runs of seven differ by thirteen times that. Hashing only lessens a
    difference, so no pair is lost.
    """
    order = np.argsort([len(t) for t in texts], kind="stable")
    texts, left = [texts[i] for i in order], left[order]
    n = np.array([len(t) for t in texts], np.int64)
    places = 1 << min(20, max(6, int(4 * n.mean()).bit_length()))
    counts, runs = _counts(texts), _sets(texts, 5, places)
    # counts of eight classes of characters differ no more than those of all, and most pairs already by these
    few = np.ascontiguousarray(counts.reshape(len(texts), 8, 8).sum(2, dtype=np.int32).T)
    out = []
    wants = np.ceil(n * threshold - 1e-6).astype(np.int64)
    ends = np.searchsorted(wants, n, "right")  # where texts begin of which n[i] isn't enough
    for i in range(len(texts)):
        lo, hi = i + 1, int(ends[i])
        if hi <= lo:
            continue
        over = n[i] + n[lo:hi] - 2 * wants[lo:hi]
        apart = np.zeros(hi - lo, np.int32)
        for row in few:
            apart += np.abs(row[lo:hi] - row[i])
        near = apart <= over
        if not (within and left[i]):
            near &= left[lo:hi] != left[i]
        at = np.flatnonzero(near)
        over, at = over[at], at + lo
        near = np.abs(counts[at] - counts[i]).sum(1) <= over
        at, over = at[near], over[near]
        near = np.bitwise_count(runs[at] ^ runs[i]).sum(1, dtype=np.int64) <= 9 * over + 8
        for j, w, o in zip(at[near].tolist(), wants[at[near]].tolist(), over[near].tolist()):
            if _share_runs(texts[i], texts[j], o) and not _apart(texts[i], texts[j], len(texts[i]) - w, len(texts[j]) - w):
                s = similarity(texts[i], texts[j])
                if s >= threshold:
                    out.append((int(order[i]), int(order[j]), s))
    return out


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        h = table["hash"].to_pylist()
        found = reaching(table["t"].to_pylist(), table["left"].to_numpy().astype(bool), table["within"][0].as_py(), threshold)
        return pa.table({"ha": pa.array([h[i] for i, _, _ in found], pa.string()), "hb": pa.array([h[j] for _, j, _ in found], pa.string()), "similarity": pa.array([s for _, _, s in found], pa.float64())})

    return run


def similar_pairs(records: DataFrame, threshold: float = 0.95, min_size: int = 100, order_col: str = "ord") -> DataFrame:
    """(a, b, similarity) of all pairs of different records whose common subsequence reaches the threshold, as a share of the longer text.

    Exact: equal texts meet by their hash, and each different text is compared with all whose length allows the threshold, by
    bounds that lose no pair and then by the subsequence itself. So the work grows with the square of the number of
    different texts of like length. An explicit operator: dedup itself never calls it.
    """
    steps = F.floor(F.log(F.length("content").cast("double")) / (math.log(1 / threshold) * (1 + 1e-9))) if 0 < threshold < 1 else F.lit(0)
    base = _hashed(records, "sha256", min_size).select(F.col(order_col).alias("o"), "hash", F.col("content").alias("t"), "size", steps.cast("long").alias("g"))
    own = base.select("o", "hash")
    a, b = own.select(F.col("o").alias("a"), F.col("hash").alias("ha")), own.select(F.col("o").alias("b"), F.col("hash").alias("hb"))
    equal = a.join(b, (F.col("ha") == F.col("hb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("similarity"))
    if threshold >= 1:
        return equal.where(F.lit(threshold) <= 1)
    # lengths in steps of the threshold: only texts of one step or of neighbouring ones can reach it. A step that is too full has
    # several chunks. A tile is a chunk with another of its step or of the next one; the first of the next (if only in name) also
    # compares the chunk with itself.
    texts = base.groupBy("hash").agg(F.first("t").alias("t"), F.first("g").alias("g"))
    full = base.select("hash", "g", "size").distinct().groupBy("g").agg(F.ceil(F.sum(F.col("size") + SIGNATURE) / CHUNK).cast("int").alias("p"))
    other = lambda by, name: full.select((F.col("g") + by).alias("g"), F.col("p").alias(name))
    chunks = full.join(other(-1, "after"), "g", "left").join(other(1, "before"), "g", "left").na.fill(0, ["before", "after"])
    placed = texts.join(F.broadcast(chunks), "g").withColumn("i", F.pmod(F.xxhash64("hash"), F.col("p")).cast("int"))
    kind = "array<struct<g:bigint,i:int,next:boolean,j:int,left:boolean>>"
    span = lambda lo, hi, make: F.when(F.lit(lo) < hi, F.transform(F.sequence(F.lit(lo), hi - 1), make)).otherwise(F.array().cast(kind))
    key = lambda g, i, next_, j, left: F.struct(g.alias("g"), i.alias("i"), next_.alias("next"), j.alias("j"), F.lit(left).alias("left"))
    g, i, no, yes = F.col("g"), F.col("i"), F.lit(False), F.lit(True)
    keys = F.concat(
        F.filter(span(0, F.col("p"), lambda j: key(g, i, no, j, True)), lambda k: k["j"] > i),
        span(0, F.greatest("after", F.lit(1)), lambda j: key(g, i, yes, j, True)),
        F.filter(span(0, F.col("p"), lambda k: key(g, k, no, i, False)), lambda k: k["i"] < i),
        span(0, F.col("before"), lambda k: key(g - 1, k, yes, i, False)),
    )
    tiles = placed.select("hash", "t", F.explode(keys).alias("k")).select("hash", "t", "k.*", (F.col("k.next") & (F.col("k.j") == 0)).alias("within"))
    close = tiles.groupBy("g", "i", "next", "j").applyInArrow(_tile(threshold), "ha string, hb string, similarity double")
    each = close.join(a, "ha").join(b, "hb")
    return equal.unionByName(each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))
