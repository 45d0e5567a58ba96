"""Operations under a journal: idempotent, version-guarded application and revert; session fences, pruning, covers."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import consolidate, lineage
from memlake.operators.filters import active
from memlake.operators.queue import prunable
from memlake.scratch import Scratch


def outcomes(memories: DataFrame, plans: DataFrame, journal: DataFrame) -> DataFrame:
    """(operation_id, winner_id, loser_id, relation, outcome) of each plan against the records as they are.

    memories: id, version, status; plans: operation_id, relation, winner_id, loser_id,
    winner_version, loser_version; journal: operation_id, status. An operation that is
    journaled as applied is not applied again; a missing, superseded or changed record
    fails, and a later run tries again.
    """
    side = lambda s: memories.select(F.col("id").alias(f"{s}_id"), F.col("version").alias(f"{s}_now"), F.col("status").alias(f"{s}_status"), F.lit(True).alias(f"{s}_there"))
    done = journal.where("status = 'applied'").select("operation_id", F.lit(True).alias("done")).distinct()
    rows = plans.join(done, "operation_id", "left").join(side("winner"), "winner_id", "left").join(side("loser"), "loser_id", "left")
    why = F.when(F.col("done"), "already_applied").when(F.col("relation") == "DISTINCT", "nothing_to_apply")
    for s in ("winner", "loser"):
        why = why.when(F.col(f"{s}_there").isNull(), f"{s}_not_found")
    for s in ("winner", "loser"):
        why = why.when(~active(f"{s}_status"), f"{s}_superseded").when(~F.col(f"{s}_now").eqNullSafe(F.col(f"{s}_version")), f"{s}_changed")
    return rows.select("operation_id", "winner_id", "loser_id", "relation", why.otherwise("applied").alias("outcome"))


def journal_rows(outcome: DataFrame) -> DataFrame:
    """Journal entries of outcomes: applied, failed with the reason, or nothing for what was there."""
    status = F.when(F.col("outcome") == "applied", "applied").otherwise("failed")
    return outcome.where(~F.col("outcome").isin("already_applied", "nothing_to_apply")).select("operation_id", "winner_id", "loser_id", "relation", status.alias("status"), F.when(status == "failed", F.col("outcome")).alias("error"), (F.col("relation") == "EQUIVALENT").alias("winner_updated"), (status == "applied").alias("loser_superseded"))


def revert_outcomes(memories: DataFrame, journal: DataFrame) -> DataFrame:
    """(operation_id, id, restore_status, outcome) for each applied entry (operation_id, loser_id, pre_status, post_version).

    A record that changed since it was superseded is left alone.
    """
    now = memories.select(F.col("id").alias("loser_id"), F.col("version").alias("now"), F.lit(True).alias("there"))
    rows = journal.where("status = 'applied'").join(now, "loser_id", "left")
    why = F.when(F.col("there").isNull(), "not_found").when(~F.col("now").eqNullSafe(F.col("post_version")), "changed_since").otherwise("reverted")
    return rows.select("operation_id", F.col("loser_id").alias("id"), F.when(why == "reverted", F.col("pre_status")).alias("restore_status"), why.alias("outcome"))


# Why a record is superseded.
REASONS = {"EQUIVALENT": "equivalent_merged", "CONFLICT": "conflict_overridden"}
FOREIGN = "cross_identity_lineage"


def absorbed(memories: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the winners of applied merges become (rows of lineage.PATCH), and the outcomes without the merges whose lineages hold a record of another identity, which fail.

    memories: id, confirmation_count, merged_ids, last_confirmed_at, and where there
    are any merged_contributions, merged_sources, source, user_id, agent_id.
    """
    scratch, has = Scratch(memories.sparkSession), set(memories.columns)
    none = F.array().cast("array<string>")
    own = F.when(F.col("source").isNotNull(), F.array("source")) if "source" in has else F.lit(None)
    said = F.col("merged_sources") if "merged_sources" in has else F.lit(None)
    who = [F.coalesce(F.col(c), F.lit("")) for c in ("user_id", "agent_id") if c in has]
    rows = lineage.member_rows(
        memories, count=consolidate.confirmations(F.col("confirmation_count")), fresh=F.col("last_confirmed_at"), contributions=F.col("merged_contributions") if "merged_contributions" in has else F.lit(None),
        sources=F.array_union(F.coalesce(said.cast("array<string>"), none), F.coalesce(own.cast("array<string>"), none)), identity=F.concat_ws("\x01", *who) if who else F.lit(None),
    )
    patches = scratch.write(lineage.absorbed(rows, outcome.where("outcome = 'applied' AND relation = 'EQUIVALENT'").select("operation_id", "winner_id", "loser_id")))
    refused = patches.where("foreign is not null").select("operation_id", "foreign")
    seen = outcome.join(refused, "operation_id", "left")
    return patches.where("foreign is null"), seen.select(*[F.when(F.col("foreign").isNotNull(), FOREIGN).otherwise(F.col(c)).alias(c) if c == "outcome" else F.col(c) for c in outcome.columns])


def applied(memories: DataFrame, outcome: DataFrame, now: int, patches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """memories after the applied outcomes, and a journal (operation_id, id, before) of each record they changed, whole.

    memories: id, status, superseded_by, merged_ids, confirmation_count,
    last_confirmed_at, updated_at and any other columns; merged_sources,
    merged_contributions, superseded_at and supersede_reason are set where they are
    columns. A winner of equal records takes in its losers in the same operation:
    the union of their lineages, each member's confirmations once, the latest
    confirmation; of a conflict the loser alone changes. patches: from absorbed(),
    found here if not given.
    """
    if patches is None:
        patches, outcome = absorbed(memories, outcome)
    done = outcome.where("outcome = 'applied'")
    gain = patches.select("id", F.col("merged_ids").alias("_ids"), F.col("confirmation_count").alias("_n"), F.col("fresh").alias("_at"), F.col("merged_sources").alias("_sources"), F.col("contributions").alias("_own"))
    lost = done.groupBy(F.col("loser_id").alias("id")).agg(F.min_by(F.struct("winner_id", "relation"), F.struct("winner_id", "relation")).alias("_by"))
    rows = memories.join(gain, "id", "left").join(lost, "id", "left")
    grown, gone = F.col("_n").isNotNull(), F.col("_by").isNotNull()
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("_by.relation")]
    new = {
        "status": F.when(gone, "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("_by.winner_id", "superseded_by"),
        "merged_ids": F.when(grown, F.col("_ids")).otherwise(F.col("merged_ids")), "confirmation_count": F.when(grown, F.col("_n")).otherwise(F.col("confirmation_count")),
        "last_confirmed_at": F.when(grown, F.greatest("last_confirmed_at", "_at")).otherwise(F.col("last_confirmed_at")), "updated_at": F.when(grown | gone, F.lit(now)).otherwise(F.col("updated_at")),
    }
    more = {"merged_sources": (grown, F.col("_sources")), "merged_contributions": (grown, F.col("_own")), "superseded_at": (gone, F.lit(now)), "supersede_reason": (gone, reason)}
    new |= {c: F.when(when, value).otherwise(F.col(c)) for c, (when, value) in more.items() if c in memories.columns}
    after = rows.select(*[new[c].cast(memories.schema[c].dataType.simpleString()).alias(c) if c in new else F.col(f"`{c}`") for c in memories.columns])
    touched = done.select("operation_id", F.col("loser_id").alias("id")).union(done.where("relation = 'EQUIVALENT'").select("operation_id", F.col("winner_id").alias("id")))
    return after, touched.join(memories.select("id", F.struct("*").alias("before")), "id").select("operation_id", "id", "before")


def restored(memories: DataFrame, journal: DataFrame) -> DataFrame:
    """memories with the records of a journal (id, before) exactly as they were; of several entries of a record the one whose state is the oldest."""
    old = journal.groupBy("id").agg(F.min_by("before", F.coalesce(F.col("before.updated_at"), F.lit(0))).alias("before"))
    rows = memories.join(old, "id", "left")
    return rows.select(*[F.when(F.col("before").isNotNull(), F.col("before").getField(c)).otherwise(F.col(f"`{c}`")).alias(c) for c in memories.columns])


def fence(captures: DataFrame) -> DataFrame:
    """(session_id, seq, allowed, blocked_by) of captures (session_id, seq, signature, refused).

    The first signature of a session holds; a refused capture, or one with another
    signature, blocks it and all that follow, with the first reason. Two aggregates a
    session, no ordered pass over it.
    """
    first = captures.groupBy("session_id").agg(F.min_by("signature", "seq").alias("own"))
    rows = captures.join(first, "session_id")
    bad = F.when(F.col("refused"), "CAPTURE_DISABLED").when(~F.col("signature").eqNullSafe(F.col("own")), "PROJECT_CONTEXT_CONFLICT")
    broken = rows.withColumn("bad", bad).where("bad is not null").groupBy("session_id").agg(F.min(F.struct("seq", "bad")).alias("b"))
    out = rows.select("session_id", "seq").join(broken, "session_id", "left")
    blocked = F.coalesce(F.col("seq") >= F.col("b.seq"), F.lit(False))
    return out.select("session_id", "seq", (~blocked).alias("allowed"), F.when(blocked, F.col("b.bad")).alias("blocked_by"))


def prune(jobs: DataFrame, states: list[str], older_than: int, now: int) -> tuple[DataFrame, DataFrame]:
    """Tombstones of the jobs to prune, and the jobs that stay: tombstones are written before anything goes."""
    gone = prunable(jobs, states, older_than, now)
    return gone.select("job_id", F.col("state").alias("final_state"), F.lit(now).alias("pruned_at")), jobs.join(gone.select("rowid"), "rowid", "left_anti")


def edge_records(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges with whether both records are there: ok, or which is missing."""
    there = lambda s: memories.select(F.col("id").alias(f"{s}_id"), F.lit(True).alias(f"{s}_there"))
    rows = edges.join(there("seed"), "seed_id", "left").join(there("neighbor"), "neighbor_id", "left")
    return rows.select("seed_id", "neighbor_id", F.when(F.col("seed_there").isNull(), "seed_missing").when(F.col("neighbor_there").isNull(), "neighbor_missing").otherwise("ok").alias("verdict"))


def exact_cover(samples: DataFrame, observations: DataFrame, key: str = "sample_id") -> DataFrame:
    """samples with their observations; a sample without one, or an observation without a sample, is an error."""
    a, b = samples.select(key), observations.select(key)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("observations don't cover the samples exactly")
    return samples.join(observations, key)


def parse_since(text: str | None, now: datetime) -> datetime | None:
    """A window of hours, days or weeks (12h, 3d, 2w) before now, or an ISO time; naive times are UTC."""
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)\s*([hdw])", text.strip(), re.I):
        from datetime import timedelta

        return now - timedelta(hours=int(m[1]) * {"h": 1, "d": 24, "w": 168}[m[2].lower()])
    try:
        when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"not a window or time: {text!r}") from e
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)
