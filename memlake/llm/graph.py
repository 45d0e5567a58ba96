"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few equi-joins and partial aggregates, written to the scratch
folder; no edge or component comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Scratch


def _large_star(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a > b): every larger neighbour of a node is tied to the node's least neighbour.

    The least neighbours are written first: the join then has an exchange of its own
    on either side, and a node with very many edges is split like any skewed key.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    out = scratch.write(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    scratch.drop(least)
    return out


def _small_star(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a > b): every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")))
    tied = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = scratch.write(tied.union(least.select("a", F.col("m").alias("b"))).distinct())
    scratch.drop(least)
    return out


def components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component: the least node that can be reached.

    edges: two columns of one orderable type, in any direction, repeats allowed.
    """
    x, y = edges.columns
    now = scratch.write(edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = None
    for _ in range(most):
        half = _large_star(scratch, now)
        new = _small_star(scratch, half)
        # settled: a forest of stars, which either star leaves as it is
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(half)
        scratch.drop(now)
        now = new
        if tuple(mark) == state or not mark[0]:
            break
        state = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
