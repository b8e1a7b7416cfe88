"""What the operators of this subpackage share: written intermediate tables, free column names, vectorised text."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one (tests) gets one below the warehouse;
    on a cluster there is no such folder to guess, and that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the plan is cut and no executor's loss undoes the work.

    The folder is deleted when the driver exits.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster's own cleaner takes the folder
        pass


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly that name, even if it holds dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about `most` bytes, each made Python's own only when it is its turn; a null counts as an
    empty text. Bounds the memory, drops nothing."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line feed after each, and where each text begins (one entry more than texts)."""
    joined = "\n".join([*texts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """The lower-case code point of letters and digits, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= M1
    h ^= h >> np.uint64(33)
    h *= M2
    h ^= h >> np.uint64(33)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, by prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(cp: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inside holds."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed_words(texts: list[str], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one entry more than texts).

    fold: words are lower-case runs of letters and digits; otherwise runs of anything but white space, as they stand.
    """
    cp, offsets = codepoints(texts)
    if fold:
        cp = alnum_table()[cp]
        inside = cp != 0
    else:
        inside = ~space_table()[cp]
    starts, ends = words(cp, inside)
    return range_hashes(cp, starts, ends), np.searchsorted(starts, offsets)


def unsigned(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def id_type(df: DataFrame, id_col: str) -> str:
    """The type an id keeps through an operator: long for all integers, otherwise its own (strings, decimals, dates)."""
    kind = df.schema[id_col].dataType
    return "bigint" if isinstance(kind, IntegralType) else kind.simpleString()


def typed_id(df: DataFrame, id_col: str) -> Column:
    return col(df, id_col).cast(id_type(df, id_col))


def id_codes(ids: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Numbers in the order of the ids (integers are their own), and what turns such numbers back to ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(**({} if isinstance(ids, pa.ChunkedArray) else {"zero_copy_only": False})).astype(np.int64), pa.array
    every = pc.unique(ids)
    every = every.take(pc.sort_indices(every))
    at = pc.index_in(ids, value_set=every)
    at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
    return at.to_numpy(zero_copy_only=False).astype(np.int64), lambda x: every.take(pa.array(x))


def exploded_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone: no other column of the input, whatever its name, can clash."""
    return df.select(typed_id(df, id_col).alias("doc_id"), col(df, text_col).cast("string").alias("text"))


__all__ = [x for x in dir() if not x.startswith("_")] + ["F"]
