"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def _checksum(edges: DataFrame) -> tuple:
    # a sum of hashes in decimal: order-free, and no overflow under ANSI arithmetic
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long), component being the smallest node reachable.

    Large star links each node's greater neighbours to its least neighbour, small star its lesser ones;
    alternated they reach one star per component in a number of rounds logarithmic in the node count.
    Minima are aggregates joined back, never windows, so that a hub's edges can be split over tasks.
    Each round is written to the shared folder; only a count and a checksum come to the driver.
    Self-loops and repeated edges are harmless, edges with a null end are dropped; no edges, no rows.
    Components that have not settled in max_rounds raise an error.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = keep(e, "cc-edges")
    before, last = _checksum(e), e
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        after = _checksum(e)
        drop(last)
        if after == before:
            break
        before, last = after, e
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
