"""Connected components by alternating stars.

Each round makes every node point its larger neighbours at the smallest
one it knows (large star) and then its smaller neighbours likewise (small
star), until edges form stars around each component's smallest node. Rounds
are few (they grow with the logarithm of the size), every one of them is a
few aggregates and joins on node ids, and its edges are written to the
shared folder, so nothing of the graph reaches the driver but a checksum.
The edges of a node that has more than a thousandth of all are dealt to
parts, so the centre of a large star is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.shared import HotKeys, Workspace


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    joined = HotKeys(least, ["a"], "n", 2 * total, look=True).join(both, least.drop("n"), ["b"])
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = HotKeys(least, ["a"], "n", total, look=True).join(edges, least.drop("n"), ["b"])
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b) but the smallest ones themselves."""
    now = space.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0", few=True)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    before, k = mark(now), 0
    while True:
        k += 1
        # a large star moves edges and adds none
        after = space.written(_small_star(_large_star(now, before[0]), before[0]), f"{name}-{k}", few=True)
        seen = mark(after)
        space.drop(f"{name}-{k - 1}")
        now = after
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen
