"""Consolidation as one run: what an earlier run left open first, then the decided pairs in order, applied with a journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import consolidate, journal
from memlake.operators.filters import active
from memlake.scratch import Scratch

PLAN = ("operation_id", "relation", "winner_id", "loser_id", "winner_version", "loser_version")


def versions(memories: DataFrame) -> DataFrame:
    """(id, version, status) of records (id, memory, status, updated_at, ...)."""
    return memories.select("id", consolidate.version(F.col("updated_at"), F.md5(F.coalesce("memory", F.lit(""))), F.col("status")).alias("version"), "status")


def plan(memories: DataFrame, decided: DataFrame) -> DataFrame:
    """decided (a, b, relation) as operations: winners by arbitration, edges in order, an edge of a record that an earlier one supersedes left out."""
    side = lambda s: memories.where(active()).select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "source", "last_confirmed_at", "confirmation_count", "created_at")])
    pairs = decided.where("relation in ('EQUIVALENT', 'CONFLICT')").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "relation").where("id_a <> id_b")
    pairs = pairs.groupBy("id_a", "id_b").agg(F.max("relation").alias("relation")).join(side("a"), "id_a").join(side("b"), "id_b")
    edges = consolidate.first_edges(consolidate.arbitrate(pairs).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "winner_id", "loser_id", "relation"))
    now = versions(memories)
    rows = edges.join(now.select(F.col("id").alias("winner_id"), F.col("version").alias("winner_version")), "winner_id").join(now.select(F.col("id").alias("loser_id"), F.col("version").alias("loser_version")), "loser_id")
    return rows.withColumn("operation_id", consolidate.operation_id(*map(F.col, ("relation", "winner_id", "loser_id", "winner_version", "loser_version")))).select(*PLAN)


def run(memories: DataFrame, decided: DataFrame, open_plan: DataFrame, done: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, outcomes, journal) after one run.

    open_plan: operations (PLAN) that an earlier run planned and may not have applied;
    they come first, against the records as they are. done: journaled operations
    (operation_id, status). Every step is written to the shared folder, so that the
    outcomes are those of one state of the records; a second run with the same pairs
    changes nothing.
    """
    scratch = Scratch(memories.sparkSession)

    def step(records: DataFrame, operations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        # a plan holds no operation of a record that an earlier one of it supersedes, so all can be judged by one state
        patches, outcome = journal.absorbed(records, scratch.write(journal.outcomes(versions(records), operations, known)))
        outcome = scratch.write(outcome)
        after, entries = journal.applied(records, outcome, now, patches)
        return scratch.write(after), outcome, scratch.write(entries)

    recovered, first, left = step(memories, scratch.write(open_plan.select(*PLAN)), done)
    known = done.select("operation_id", "status").unionByName(first.where("outcome = 'applied'").select("operation_id", F.lit("applied").alias("status")))
    after, second, right = step(recovered, scratch.write(plan(recovered, decided)), known)
    return after, first.withColumn("phase", F.lit("recovery")).unionByName(second.withColumn("phase", F.lit("run"))), left.unionByName(right)
