"""Arrow functions that can be defined before there is a Spark session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like arrow_udf, but the type is read at the first call."""

    def of(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            # nondeterministic to the optimizer: so no rule copies the call or moves it into another expression
            return F.arrow_udf(f, kind).asNondeterministic()(*columns)

        return call

    return of


#: Bytes of text that are Python's strings at once in a function by parts.
PART = 2_000_000


def by_parts(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """f over slices of the columns, of PART bytes of the first one at most or else one row, put together again. So a worker holds
    a batch and its result, of which Spark bounds the first, but not both as Python's strings besides."""

    @wraps(f)
    def run(texts: pa.Array, *more: pa.Array) -> pa.Array:
        if texts.nbytes <= PART:
            return f(texts, *more)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0]
        while cuts[-1] < len(texts):
            a = cuts[-1]
            cuts.append(max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, "right"))))
        return pa.concat_arrays([f(*[x.slice(a, b - a) for x in (texts, *more)]) for a, b in zip(cuts, cuts[1:])])

    return run
