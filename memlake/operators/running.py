"""Running sums over groups of any size, and greedy packing of ordered rows by successor pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.scratch import Scratch


def running(rows: DataFrame, group: str, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums, each over the rows of a group up to this one in the order of keys (which tell the rows of a group apart).

    Rows are sorted by ranges; a range's own sums and those of the ranges before it
    are added, so that a group may be as large as the table.
    """
    scratch = Scratch(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("*", *[e.alias(f"_v_{c}") for c, e in sums.items()]).repartitionByRange(parts, group, *keys)
    ranged = scratch.write(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(group, "_part").agg(*[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums])
    bases = totals.select(group, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    own = Window.partitionBy(group, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select(*rows.columns, "_part", *[F.sum(f"_v_{c}").over(own).alias(f"_o_{c}") for c in sums]).join(bases, [group, "_part"])
    return out.select(*rows.columns, *[(F.col(f"_o_{c}") + F.col(f"_b_{c}")).alias(c) for c in sums])


def greedy_bins(rows: DataFrame, group: str, keys: list[str], size: str, limit: int) -> DataFrame:
    """rows with bin, from 0 in each group: in the order of keys, a bin takes the next row while its sizes stay within the limit; a first row is always taken.

    size: a whole number, not negative. Prefix sums say where a bin that begins at a
    row would end, for every row at once; the bins that the first row leads to are
    marked by doubling. Each round is a join; there are twice as many rounds as the
    number of bins has binary digits.
    """
    scratch = Scratch(rows.sparkSession)
    plain = rows.select(group, *keys, F.col(size).cast("bigint").alias("_n"))
    at = running(plain, group, keys, {"_end": F.col("_n"), "_k": F.lit(1)}).withColumn("_k", F.col("_k") - 1)
    at = scratch.write(at)
    # the first row whose end lies beyond the bin's: ends and limits in one order, ends first where they are equal
    ends = at.select(group, F.col("_end").alias("_value"), F.lit(0).alias("_asks"), "_k", F.lit(1).alias("_one"))
    asks = at.select(group, (F.col("_end") - F.col("_n") + limit).alias("_value"), F.lit(1).alias("_asks"), "_k", F.lit(0).alias("_one"))
    found = running(ends.union(asks), group, ["_value", "_asks", "_k"], {"_upto": F.col("_one")}).where("_asks = 1")
    jump = scratch.write(found.select(group, F.col("_k").alias("_from"), F.greatest(F.col("_k") + 1, F.col("_upto")).alias("_to")))
    last = at.groupBy(group).agg(F.max("_k").alias("_last"))
    jump = scratch.write(jump.join(last, group).where("_to <= _last").select(group, "_from", "_to"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = scratch.write(jump.join(jump.select(group, F.col("_from").alias("_to"), F.col("_to").alias("_far")), [group, "_to"]).select(group, "_from", F.col("_far").alias("_to")))
    marked = scratch.write(at.where("_k = 0").select(group, F.col("_k").alias("_from")))
    for step in reversed(jumps):
        marked = scratch.write(marked.union(marked.join(step, [group, "_from"]).select(group, F.col("_to").alias("_from"))))
    begins = marked.select(group, F.col("_from").alias("_k"), F.lit(1).alias("_begin"))
    numbered = running(at.join(begins, [group, "_k"], "left"), group, ["_k"], {"bin": F.coalesce("_begin", F.lit(0))})
    return numbered.select(group, *keys, (F.col("bin") - 1).alias("bin"))
