"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.lookups import fair_share, lookup
from rankloom.llm.work import drop, table


def with_least(pairs: DataFrame, share: int) -> DataFrame:
    """Every pair (u, v) with m, the least v of its u; a node of very many pairs doesn't meet in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return lookup(pairs, least, "u", share, "inner")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (u, v) but the smallest of each component.

    Each round hangs a node's larger neighbours on its smallest neighbour, then
    its smaller ones; rounds grow with the logarithm of a component's diameter.
    Every round is a stored table, which replaces the one before. Edges shrink to
    one per node, so no group is gathered: minima are aggregated before their
    shuffle, and a hub's minimum is broadcast to its edges instead of the edges
    going to it.
    """
    current = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark.n == 0 or mark == before:
            break
        before = mark
        share = fair_share(2 * mark.n, current)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, share).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = with_least(large, share).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = table(small.where("u <> v").distinct(), "edges")
        drop(current)
        current = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
