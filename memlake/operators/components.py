"""Connected components of an edge table by hooking and jumping: a round is a few equi-joins with partial aggregates, and rounds grow with the logarithm of the longest way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.scratch import Scratch


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component: the least node that can be reached.

    edges: two columns of one orderable type, in any direction, repeats allowed; nulls
    and loops say nothing. Every node points at a node that is not greater. A round
    looks two steps up: the least grandparent among a node's neighbours is offered to
    the node and to its parent, and a node takes the least of what it is offered and
    its own grandparent. The parents settle when all point at their component's least.
    """
    scratch = Scratch(edges.sparkSession)
    x, y = (F.col(f"`{c}`") for c in edges.columns)
    real = edges.where(x != y)
    both = scratch.write(real.select(x.alias("u"), y.alias("v")).union(real.select(y.alias("u"), x.alias("v"))).distinct())
    now = scratch.write(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("f")))
    state = None
    for _ in range(most):
        up = scratch.write(now.join(now.select(F.col("u").alias("f"), F.col("f").alias("g")), "f").select("u", "f", "g"))
        least = both.join(up.select(F.col("u").alias("v"), F.col("g").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        seen = up.join(least, "u")
        offers = seen.select("u", F.least("f", "g", "m").alias("f")).union(seen.select(F.col("f").alias("u"), F.col("m").alias("f")))
        new = scratch.write(offers.groupBy("u").agg(F.min("f").alias("f")))
        for old in (up, now):
            scratch.drop(old)
        now = new
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "f").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("f").alias("component"))
        state = mark
    raise RuntimeError("components did not settle")
