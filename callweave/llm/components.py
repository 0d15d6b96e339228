"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone.

Each step is one pre-aggregated minimum per node and one join, so a node with very many
neighbours is an ordinary skewed join that adaptive execution splits; no group is gathered.
The edges of every step are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)``, either direction, repeats and loops allowed; nulls are ignored.

    Returns ``(node, component)`` for every node of an edge, component being the smallest node it reaches.
    """
    clean = edges.where("a is not null and b is not null")
    now = scratch.save(clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while before != (mark := _mark(now)):
        before = mark
        if not mark[0]:
            break
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        after = scratch.save(_star(large, large=False))
        scratch.drop(now)
        now = after
    loops = clean.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and two order-free checksums: equal before and after only at the fixpoint."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of u gets the least of u's neighbours and u. Small: the same for lesser ones and u itself (edges u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
