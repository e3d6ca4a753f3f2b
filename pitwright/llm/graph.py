"""Connected components of an edge table by alternating star contraction.

Each half-round groups by node with a map-side minimum and joins the minima back, so a hub's edges are never
gathered in one task: the minima are written first, and the join of two plain tables is one that adaptive
execution can split at a hot key. The edges stay in the shared folder; only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    mins = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "star-min")
    joined = pairs.join(mins, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(mins.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return cut(out.where("a <> b").distinct(), "star")


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node reachable.

    Edges with a null end and loops are ignored. Nodes without edges don't appear: each is its own root.
    """
    now = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = _star(_star(now, large=False), large=True)
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
