"""Awkward inputs for every operator."""

import sys
from pathlib import Path

import pytest

HERE = Path(__file__).parent
sys.path.insert(0, str(HERE))

CLASHING = ["h", "sig", "key", "a", "b", "u", "v", "doc", "kept", "kind", "verdict", "secret", "_lid", "_candidates", "_lives", "_p", "_tokens", "_source", "r", "x", "y", "probability", "rank", "id", "group_id", "__gone_id", "_c0", "shard", "items", "digest"]
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=BASE, extra=True):
    """A table with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(f"extra-{c}") for c in CLASHING if c.lower() not in have}) if extra else df


@pytest.fixture
def docs(spark):
    def of(texts, langs=None, sources=None, ids=None, extra=True):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [(ids[i], t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t) if t is not None else None) for i, t in enumerate(texts)]
        return table(spark, rows, extra=extra)

    return of

