"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge, with the least node that it is connected to.

    Each round finds every node's least neighbour by a minimum, which combines before the shuffle, and joins it back, where a
    node with very many neighbours can be split; and writes a table. The number of rounds grows with the logarithm of the
    longest path. Null ends and loops of a node to itself are dropped; repeated edges count once. An empty table gives an
    empty one. Nodes are of any type that has an order.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct()
    e, before = materialize(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: the larger ends and u itself all move to u's least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(ends.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
