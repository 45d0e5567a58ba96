"""Migration of records into another collection, in batches under a ledger, so that a run that was stopped goes on where it stood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import consolidate

LEDGER = "batch int, written bigint, digest decimal(38,0), skipped bigint, conflicted bigint"


def digest(columns: list[str]) -> Column:
    """A hash of a multiset of rows: the sum of the rows' hashes, alike in any order and mergeable by addition."""
    return F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.schema(LEDGER.split(", ", 1)[1] + ", batch int").parquet(path).select("batch", "written", "digest", "skipped", "conflicted") if there else spark.createDataFrame([], LEDGER)


def migrate(source: DataFrame, target: DataFrame, batch: Column, out: str, make: Callable[[DataFrame], DataFrame] | None = None, stop: Callable[[int, str], None] | None = None) -> DataFrame:
    """The ledger (LEDGER) after a run: what of source is new to target, or has another profile, is written to ``out``/data by batch.

    source, target: id, payload, profile; source may have more columns. batch: a small
    whole number from columns of source, the same in every run. make: adds columns to
    the rows of a batch, such as new vectors; it keeps their number. A conflicting
    record (another payload under its id) is counted and not written.

    A batch is written whole, over what a stopped run may have left of it, read again
    and compared by number and multiset hash, and then entered in ``out``/ledger. A
    batch whose entry says what the source says now is not written again, so a run
    that stops anywhere and is resumed repeats one batch at most. stop is called
    before and after each step, for tests.
    """
    spark, columns = source.sparkSession, source.columns
    tell = stop or (lambda k, step: None)
    rows = source.withColumn("_batch", batch.cast("int")).join(consolidate.reindex_classes(source, target), "id")
    moves = F.col("action").isin("new", "recompute")
    hashes = F.coalesce(F.sum(F.when(moves, F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))
    count = lambda c, name: F.count_if(c).alias(name)
    want = rows.groupBy(F.col("_batch").alias("batch")).agg(count(moves, "written"), hashes.cast("decimal(38,0)").alias("digest"), count(F.col("action") == "skipped", "skipped"), count(F.col("action") == "conflicted", "conflicted"))
    want = {r.batch: r for r in want.collect()}  # one row a batch
    done = {r.batch: r for r in _ledger(spark, f"{out}/ledger").collect()}
    for k in sorted(want):
        if k in done and done[k] == want[k]:
            continue
        tell(k, "write")
        mine = rows.where((F.col("_batch") == k) & moves).select(*columns)
        (make(mine) if make else mine).write.mode("overwrite").parquet(f"{out}/data/batch={k}")
        tell(k, "verify")
        got = spark.read.parquet(f"{out}/data/batch={k}").agg(F.count("*").alias("n"), digest(columns).cast("decimal(38,0)").alias("d")).first()
        if (got.n, got.d) != (want[k].written, want[k].digest):
            raise RuntimeError(f"batch {k} holds {got.n} rows with hash {got.d}, not {want[k].written} with {want[k].digest}")
        tell(k, "enter")
        spark.createDataFrame([tuple(want[k])], LEDGER).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch={k}")
    return _ledger(spark, f"{out}/ledger")


def migrated(spark: SparkSession, out: str) -> DataFrame:
    """The rows that the ledger vouches for."""
    return spark.read.parquet(f"{out}/data").join(F.broadcast(_ledger(spark, f"{out}/ledger").select("batch")), "batch", "left_semi")


def verified(source: DataFrame, target: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source_count, target_before, written, skipped, conflicted, complete): complete if every record of source is written, skipped or conflicting."""
    sums = ledger.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("written", "skipped", "conflicted")])
    counts = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_count"), F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("target_before"))
    # two tables of one row each
    both = counts.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("complete", F.col("written") + F.col("skipped") + F.col("conflicted") == F.col("source_count"))
