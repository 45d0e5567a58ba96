"""A job's life as a fold over its actions in order, alike in a batch and on a stream.

Actions: job_id, moment (epoch seconds), seq (order), action, retryable. A job that is
enqueued again, or after its tombstone, stays as it is; only a pending job that is
due can be claimed; a claim that outlives its lease fails with a further try; the
third failure, or one that can't be tried again, is the last; dead and skipped jobs
can be put back by hand; a pruned job leaves a tombstone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators import queue, sessions
from memlake.operators.queue import LEASE, MAX_ATTEMPTS, TERMINAL

ACTIONS = ("enqueue", "claim", "complete", "skip", "fail", "expire", "retry", "prune")
RETRYABLE = ("dead", "skipped")
SCHEMA = "job_id string, state string, attempt int, not_before bigint, claimed_at bigint, tombstone boolean, actions bigint"
_STATE = "state string, attempt int, not_before bigint, claimed_at bigint, tombstone boolean, actions bigint"


class Job(NamedTuple):
    state: str | None = None  # None: there is no such job
    attempt: int = 0
    not_before: int = 0
    claimed_at: int | None = None
    tombstone: bool = False
    actions: int = 0


def advance(job: Job, at: int, action: str, retryable: bool | None) -> Job:
    """The job after one action; an action that isn't allowed changes nothing but the count."""
    job = job._replace(actions=job.actions + 1)
    if action == "enqueue":
        return job if job.tombstone or job.state else job._replace(state="pending", attempt=0, not_before=0, claimed_at=None)
    if job.state is None:
        return job
    if action == "claim":
        return job._replace(state="processing", claimed_at=at) if job.state == "pending" and job.not_before <= at else job
    if action == "complete":
        return job._replace(state="completed", claimed_at=None)
    if action == "skip":
        return job._replace(state="skipped", claimed_at=None)
    if action == "expire" and not (job.state == "processing" and at - (job.claimed_at or 0) > LEASE):
        return job
    if action in ("fail", "expire"):
        attempt = job.attempt + 1
        if (action == "expire" or retryable) and attempt < MAX_ATTEMPTS:
            return job._replace(state="pending", attempt=attempt, not_before=at + 5 * 2**attempt, claimed_at=None)
        return job._replace(state="dead", attempt=attempt, claimed_at=None)
    if action == "retry":
        return job._replace(state="pending", attempt=0, not_before=0, claimed_at=None) if job.state in RETRYABLE else job
    if action == "prune":
        return job._replace(state=None, tombstone=True, claimed_at=None) if job.state in TERMINAL else job
    raise ValueError(f"unknown action {action!r}")


def final_states(actions: DataFrame) -> DataFrame:
    """Each job after all its actions (the columns of SCHEMA); a task folds its sorted rows and holds one job at a time."""
    rows = actions.select("job_id", "moment", "seq", "action", "retryable").repartition("job_id").sortWithinPartitions("job_id", "moment", "seq")

    def run(batches):
        now, job, out = None, Job(), []
        for b in batches:
            for name, at, action, retryable in zip(*[b.column(c).to_pylist() for c in ("job_id", "moment", "action", "retryable")]):
                if name != now:
                    if now is not None:
                        out.append((now, *job))
                    now, job = name, Job()
                job = advance(job, at, action, retryable)
            if len(out) > 5000:
                yield _table(out)
                out = []
        if now is not None:
            out.append((now, *job))
        if out:
            yield _table(out)

    return rows.where(F.col("job_id").isNotNull()).mapInArrow(run, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.strip().split()[0] for f in SCHEMA.split(",")])


def _loaded(state: GroupState) -> Job:
    return Job(*state.get) if state.exists else Job()


def _follow(lease: bool):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = _loaded(state)
        if state.hasTimedOut:  # nobody reported back: the lease is over
            job = advance(job, (job.claimed_at or 0) + LEASE + 1, "expire", True)
        else:
            rows = sorted(r for pdf in batches for r in zip(pdf["moment"].tolist(), pdf["seq"].tolist(), pdf["action"].tolist(), pdf["retryable"].tolist()))
            for at, _, action, retryable in rows:
                job = advance(job, int(at), action, None if retryable is None else bool(retryable))
        state.update(tuple(job))
        if lease and job.state == "processing":
            state.setTimeoutDuration(LEASE * 1000)
        yield pd.DataFrame([(key[0], *job)], columns=["job_id", *Job._fields]).astype({"claimed_at": "Int64"})

    return update


def follow(actions: DataFrame, lease: bool = False) -> DataFrame:
    """The same on a stream: each job's state is six values, updates come out as jobs change. lease: claims expire by the clock."""
    rows = actions.select("job_id", "moment", "seq", "action", "retryable")
    return rows.groupBy("job_id").applyInPandasWithState(_follow(lease), SCHEMA, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if lease else GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """Of each job the update after its last action."""
    rest = ("state", "attempt", "not_before", "claimed_at", "tombstone", "actions")
    return updates.groupBy("job_id").agg(F.max_by(F.struct(*rest), "actions").alias("s")).select("job_id", "s.*")


def process(jobs: DataFrame, turns: DataFrame, receipts: DataFrame, project: str = "") -> DataFrame:
    """What becomes of claimed jobs (job_id, conv_id): (job_id, action, reason, cursor).

    turns: conv_id, turn, role, content; receipts: cursor. A session without turns or
    with nothing but noise is skipped, as is one whose cursor has a receipt or that an
    earlier job of the same run has; all others complete, with their cursor as receipt.
    """
    said = turns.where(F.trim(F.coalesce("content", F.lit(""))) != "")
    verdict = sessions.skip_sessions(said).select("conv_id", "skip", F.col("reason").alias("why"))
    line = F.struct(F.col("role").alias("role"), F.col("content").alias("content"))
    whole = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]).alias("turns")).join(queue.goals(said), "conv_id")
    cursor = queue.semantic_cursor(F.lit(project), F.col("conv_id").cast("string"), F.col("last_goal"), F.col("last_reply"), F.array().cast("array<string>"), F.col("turns"))
    rows = jobs.select("job_id", "conv_id").join(verdict, "conv_id", "left").join(whole.select("conv_id", cursor.alias("cursor")), "conv_id", "left")
    rows = rows.join(receipts.select("cursor", F.lit(True).alias("seen")).distinct(), "cursor", "left")
    first = rows.where("not skip").groupBy("cursor").agg(F.min("job_id").alias("first"))
    rows = rows.join(first, "cursor", "left")
    why = (
        F.when(F.col("skip").isNull(), "no_turns").when(F.col("skip"), F.col("why")).when(F.col("seen"), "already_distilled").when(F.col("job_id") != F.col("first"), "already_distilled")
    )
    return rows.select("job_id", F.when(why.isNull(), "complete").otherwise("skip").alias("action"), why.alias("reason"), F.when(why.isNull(), F.col("cursor")).alias("cursor"))
