"""Connected components by alternating large-star and small-star.

Both steps are a minimum for each node and a join back on the node, so no node's neighbours ever meet in one
list; a node with very many links is a skewed join key, which adaptive execution splits. Edges are written to
the shared folder after each round, and rounds end when they are stars: no centre is itself linked to another
node, and no node has two centres. Each star's centre is then the smallest node of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Scratch

#: Rounds needed grow with the logarithm of the longest path; this many end any graph that fits a cluster.
MOST_ROUNDS = 60


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour (or to itself, if smaller)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.join(m, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to its smallest neighbour."""
    down = edges.filter(F.col("u") > F.col("v"))
    m = _minimum(down)
    moved = down.join(m, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("centre"), F.lit(False).alias("is_centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("bigint").alias("centre"), F.lit(True).alias("is_centre")))
    seen = ends.groupBy("x").agg(F.min("centre").alias("a"), F.max("centre").alias("b"), F.max("is_centre").alias("c"))
    return seen.filter(F.col("a").isNotNull() & ((F.col("a") != F.col("b")) | F.col("c"))).isEmpty()


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (its smallest node), for each node that isn't the smallest of its component.

    edges: two columns of ids, in any direction, repeated or not; null ends and loops are ignored.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull())
    old = None
    for i in range(MOST_ROUNDS):
        e = scratch.write(small_star(large_star(e)), f"{name}-{i}")
        if old:
            scratch.drop(old)
        if are_stars(e):
            break
        old = f"{name}-{i}"
    else:
        raise RuntimeError(f"components: no stars after {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
