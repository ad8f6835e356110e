"""Connected components of an edge list by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import stored


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and its partners; a hub's pairs are split by the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("n")).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star over (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _toward_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    near = _toward_minimum(large)
    moved = near.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the smallest node that can be reached.

    The edges shrink to stars round by round; each round is stored in the shared
    folder. Self links and repeated edges are allowed; an empty list gives no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = stored(edges, name), None
    while True:
        n, trace = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if n == 0 or (n, trace) == before:
            break
        before = (n, trace)
        edges = stored(_round(edges), name)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
