"""Connected components of an edge list by alternating large-star / small-star rounds.

Nodes are longs. Defined cases: repeated edges and loops add nothing; an edge with a null end is left out; an
empty list gives no rows; nodes without edges are not in the result. Hubs (nodes with over
1/1000 of all edges, fewer than 1000 of them) meet their one-row minimum by broadcast, so
their edges are never gathered in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .hot_join import attach, hot_keys


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node
    of its component. Each round is a few shuffles of the edges and is written to
    the checkpoint folder; the number of rounds grows with the log of the size.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    held = cut_lineage(edges.where("a <> b").select(a, b).distinct())
    mark = _mark(held)
    while True:
        # large star: every larger neighbour of u gets u's smallest neighbour
        both = held.select("a", "b").union(held.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = attach(both.where("v > u"), least.select("u", "m"), "u", hot_keys(least, "u", "n"))
        large = cut_lineage(large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # small star: u and its smaller neighbours get the smallest of them
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        pairs = attach(large, low.select("a", "m"), "a", hot_keys(low, "a", "n")).select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        held = cut_lineage(pairs.select("e.a", "e.b").where("a <> b").distinct())
        was, mark = mark, _mark(held)
        if was == mark:
            break
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        held.select(F.col("b"), F.col("b")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
