"""Hashes of text and bytes as Columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow
from .text import SPACE, lines, not_blank


def calculate_hash(data: Column, algorithm: str = "sha256") -> Column:
    """md5, sha1, sha256 or sha512 in hexadecimal; another name means sha256."""
    return {"md5": F.md5, "sha1": F.sha1, "sha512": lambda x: F.sha2(x, 512)}.get(algorithm, lambda x: F.sha2(x, 256))(data)


def multiple_hashes(data: Column) -> Column:
    return F.struct(*[calculate_hash(data, a).alias(a) for a in ("md5", "sha1", "sha256", "sha512")])


def verify_hash(data: Column, expected: Column, algorithm: str = "sha256") -> Column:
    return calculate_hash(data, algorithm) == F.lower(expected)


def checksum(t: Column) -> Column:
    """The sum of code points modulo 65536."""
    return F.aggregate(F.transform(F.split(t, ""), F.ascii), F.lit(0).cast("long"), lambda a, x: a + x) % 65536


@arrow("string")
def similarity_hash(texts: pa.Array) -> pa.Array:
    """SHA-256 of the MD5s of all three-character runs, or of the text itself below three."""
    out = []
    for t in texts.to_pylist():
        if t is None:
            out.append(None)
            continue
        h = hashlib.sha256()
        if len(t) < 3:
            h.update(t.encode())
        for i in range(len(t) - 2):
            h.update(hashlib.md5(t[i : i + 3].encode()).hexdigest().encode())
        out.append(h.hexdigest())
    return pa.array(out, pa.string())


def content_fingerprint(t: Column) -> Column:
    """Blind to white space and case."""
    return F.sha2(F.lower(F.regexp_replace(t, rf"(?U){SPACE}+", "")), 256)


def structural_hash(t: Column) -> Column:
    """SHA-256 of line counts, mean length and mean indent, the means to two places by half-even rounding."""
    ls = lines(t)
    full = F.filter(ls, not_blank)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    mean = lambda x, n: F.call_function("format_number", F.coalesce(F.try_divide(total(x), n), F.lit(0.0)), F.lit("0.00"))
    indent = F.transform(full, lambda x: F.length(x) - F.length(F.regexp_replace(x, rf"(?U)\A{SPACE}+", "")))
    text = F.concat(F.lit("lines:"), F.size(ls), F.lit(",non_empty:"), F.size(full), F.lit(",avg_length:"), mean(F.transform(ls, F.length), F.size(ls)), F.lit(",avg_indent:"), mean(indent, F.size(full)))
    return F.sha2(text, 256)
