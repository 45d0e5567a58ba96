"""The capture queue: identity of jobs, dedup, leases, retries, coalescing, pruning, audit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.functions import text as tx
from memlake.scratch import Scratch

LEASE, MAX_ATTEMPTS, MAX_TURNS, MAX_FILES = 300, 3, 20, 30
STATES = ("pending", "processing", "completed", "skipped", "coalesced", "dead")
TERMINAL = ("completed", "skipped", "coalesced", "dead")


def job_id(host: Column, session: Column, event: Column, boundary: Column) -> Column:
    raw = F.concat_ws(":", F.lower(host), session, event, boundary)
    return F.concat(F.lower(host), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 16))


def first_of_each(jobs: DataFrame) -> DataFrame:
    """The earliest row of each job id: a partial aggregate, so a job sent many times costs one row a task."""
    rest = [c for c in jobs.columns if c != "job_id"]
    return jobs.groupBy("job_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "rowid")).alias("r")).select("job_id", "r.*")


def barred(jobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Jobs without a tombstone."""
    return jobs.join(tombstones.select("job_id").distinct(), "job_id", "left_anti")


def reconcile(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """What an index of active jobs lacks or has too much: (job_id, change)."""
    live = jobs.where(F.col("state").isin("pending", "processing")).select("job_id").distinct()
    return live.join(index, "job_id", "left_anti").select("job_id", F.lit("added").alias("change")).union(index.select("job_id").distinct().join(live, "job_id", "left_anti").select("job_id", F.lit("removed").alias("change")))


def retry(attempt: Column, now: Column, max_attempts: int = MAX_ATTEMPTS) -> tuple[Column, Column]:
    """State and not_before after a failed attempt: 10 s, 20 s, then dead."""
    nxt = attempt + 1
    return F.when(nxt >= max_attempts, "dead").otherwise("pending"), F.when(nxt < max_attempts, now + F.pow(F.lit(2.0), nxt).cast("bigint") * 5)


def expired_leases(jobs: DataFrame, now: int, lease: int = LEASE) -> DataFrame:
    """Processing jobs whose claim is older than the lease, with what becomes of them."""
    state, at = retry(F.col("attempt"), F.lit(now))
    return jobs.where((F.col("state") == "processing") & (F.col("claimed_at") < now - lease)).select("job_id", "attempt", state.alias("next_state"), at.alias("not_before"))


def ready(jobs: DataFrame, now: int) -> DataFrame:
    """Pending jobs that may run, oldest first."""
    return jobs.where((F.col("state") == "pending") & (F.col("not_before") <= now)).orderBy("created_at", "job_id")


def prunable(jobs: DataFrame, states: list[str], older_than: int, now: int) -> DataFrame:
    """Jobs in terminal states of at least this age."""
    if older_than < 0:
        raise ValueError("age must not be negative")
    if not states or set(states) - set(TERMINAL):
        raise ValueError(f"only terminal states can be pruned: {TERMINAL}")
    return jobs.where(F.col("state").isin(states) & (F.coalesce("updated_at", "created_at") <= now - older_than))


def status_counts(jobs: DataFrame) -> DataFrame:
    """A count of every state, zero where there is none."""
    states = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(jobs.groupBy("state").agg(F.count("*").alias("n")), "state", "left").fillna(0, ["n"])


def audit_dead(jobs: DataFrame, ledger: DataFrame, receipts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What to do with each dead job: (job_id, decision)."""
    rows = jobs.where("state = 'dead'").join(ledger.select("session_id", "blocked"), "session_id", "left")
    rows = rows.join(receipts.select("job_id", F.lit(True).alias("receipt")), "job_id", "left").join(tombstones.select("job_id", F.lit(True).alias("tombstone")), "job_id", "left")
    why = F.when(F.col("tombstone"), "already_pruned").when(F.col("receipt"), "already_processed").when(F.col("blocked").isNull(), "no_ledger").when(F.col("blocked"), "identity_blocked").otherwise("retryable")
    return rows.select("job_id", why.alias("decision"))


def last_turns(turns: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """The last n turns of each conversation; the limit is applied before the shuffle, too."""
    return turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("r") <= n)


def goals(turns: DataFrame) -> DataFrame:
    """(conv_id, last_goal, last_reply): the last user turn that is no shutdown command, the last reply."""
    said = tx.strip(F.coalesce("content", F.lit("")))
    mine = (F.col("role") == "user") & (said != "") & ~F.lower(said).isin(tx.SHUTDOWN_COMMANDS)
    reply = (F.col("role") == "assistant") & (said != "")
    return turns.groupBy("conv_id").agg(F.coalesce(F.max_by(said, F.when(mine, F.col("turn"))), F.lit("")).alias("last_goal"), F.coalesce(F.max_by(said, F.when(reply, F.col("turn"))), F.lit("")).alias("last_reply"))


def semantic_cursor(project: Column, session: Column, goal: Column, reply: Column, files: Column, turns: Column) -> Column:
    """Equal for captures that say the same: files as a set, turns (role, content) without shutdown commands."""
    line = lambda t: F.concat(F.lower(t["role"]), F.lit(":"), tx.strip(t["content"]))
    said = F.filter(turns, lambda t: (tx.strip(t["content"]) != "") & ~((F.lower(t["role"]) == "user") & F.lower(tx.strip(t["content"])).isin(tx.SHUTDOWN_COMMANDS)))
    digest = F.when(F.size(said) > 0, F.substring(F.sha2(F.array_join(F.transform(said, line), "\n"), 256), 1, 16)).otherwise("")
    parts = [("proj=", F.trim(project)), ("\nsess=", F.trim(session)), ("\ngoal=", goal), ("\nreply=", F.trim(reply)), ("\nfiles=", F.array_join(F.array_sort(F.array_distinct(files)), ",")), ("\nturns=", digest)]
    return F.sha2(F.concat(*[x for name, c in parts for x in (F.lit(name), F.coalesce(c, F.lit("")))]), 256)


# What captures have in common that may be coalesced.
GROUP = ("schema_version", "host", "session_id", "user_id", "namespace", "context_key", "mode", "revision", "segment")
#: Turns of a group's older snapshots that one task compares with its newest.
BUCKET_TURNS = 2_000_000
#: Base of the polynomial hash, modulo 2^64; turns are mixed to 64 bits before.
_BASE = 0x9E3779B97F4A7C15


def held(newest: np.ndarray, older: list[np.ndarray]) -> np.ndarray:
    """Whether each of older stands in newest in a row (digests of turns). An empty one does.

    The prefix hashes of the newest give the hash of each of its windows; for each
    length that is asked for, hashes are matched at once, and a match is compared.
    """
    n = len(newest)
    power = np.full(n + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)

    def prefixes(x: np.ndarray) -> np.ndarray:
        """P[k]: the sum of x[j] * base^j for j < k."""
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x.astype(np.uint64) * power[: len(x)], dtype=np.uint64)])

    whole, out = prefixes(newest), np.zeros(len(older), dtype=bool)
    lengths = np.array([len(x) for x in older], dtype=np.int64)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        if not length:
            out[mine] = True
        if not length or length > n:
            continue
        # each window's hash, freed of the power of the base that its place brings
        windows = (whole[length:] - whole[: n - length + 1]) * _inverses(n)[: n - length + 1]
        order = np.argsort(windows, kind="stable")
        asked = np.array([prefixes(older[k])[-1] for k in mine], dtype=np.uint64)
        first = np.searchsorted(windows[order], asked)
        for k, at, h in zip(mine.tolist(), first.tolist(), asked):
            while at < len(order) and windows[order[at]] == h and not out[k]:
                i = order[at]
                out[k] = np.array_equal(newest[i : i + length], older[k])
                at += 1
    return out


def _inverses(n: int) -> np.ndarray:
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(down)


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: job_id and digests of older snapshots; right: the digests of their newest, one row."""
    some = left.num_rows and right.num_rows
    newest = np.asarray(right.column("digests").combine_chunks().values, dtype=np.int64).view(np.uint64) if some else None
    lists = left.column("digests").combine_chunks()
    bounds, values = np.asarray(lists.offsets), np.asarray(lists.values, dtype=np.int64).view(np.uint64)
    inside = held(newest, [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]) if some else np.zeros(left.num_rows, dtype=bool)
    return pa.Table.from_arrays([left.column("row"), pa.array(inside, pa.bool_())], names=["row", "inside"])


def coalesce_sessions(snapshots: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """(job_id, session_id, state, superseded_by) of pending snapshots: an older one whose turns the newest of its group holds in a row is coalesced.

    snapshots: job_id, session_id, created_at, turns (texts, or structs of role and
    content), and any of GROUP and transcript_path. Captures are of one group where
    they agree in all columns of GROUP that are there; one whose user_id is null has
    no identity yet and stays pending. An older one without turns is coalesced unless
    it names a transcript. Equal times go by job_id.

    Turns travel as digests of eight bytes. A group's older snapshots are dealt into
    buckets by the sum of their turns, and the newest's digests go to each bucket
    once, so that a session of any number of snapshots is spread.
    """
    scratch, has = Scratch(snapshots.sparkSession), set(snapshots.columns)
    keys = [c for c in GROUP if c in has]
    plain = "struct" not in snapshots.schema["turns"].dataType.simpleString()
    turn = (lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("\0")), t.isNull())) if plain else (lambda t: F.xxhash64(F.coalesce(t["role"], F.lit("")), tx.strip(F.coalesce(t["content"], F.lit("")))))
    known = F.col("user_id").isNotNull() if "user_id" in has else F.lit(True)
    path = F.nullif(F.col("transcript_path"), F.lit("")).isNotNull() if "transcript_path" in has else F.lit(False)
    group = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keys]), F.struct(*[F.col(c).cast("string").alias(c) for c in keys])
    digests = F.coalesce(F.transform("turns", turn), F.array().cast("array<bigint>"))
    rows = scratch.write(snapshots.select("job_id", "session_id", "created_at", known.alias("known"), path.alias("path"), group[0].alias("g"), group[1].alias("group"), digests.alias("digests"), F.monotonically_increasing_id().alias("row")))
    when = F.struct("created_at", "job_id", "row")
    newest = scratch.write(rows.where("known").groupBy("g", "group").agg(F.max(when).alias("n"), F.sum(F.size("digests").cast("bigint")).alias("turns")))
    newest = newest.select("g", "group", F.col("n.row").alias("new_row"), F.col("n.job_id").alias("new_id"), F.ceil((F.col("turns") + 1) / bucket_turns).cast("int").alias("buckets"))
    older = scratch.write(rows.where("known").join(newest, ["g", "group"]).where("row <> new_row"))
    asked = older.where(F.size("digests") > 0).select("new_row", F.pmod(F.xxhash64("row"), "buckets").cast("int").alias("bucket"), "row", "digests")
    there = rows.join(newest.select("new_row", "buckets"), F.col("row") == F.col("new_row")).where(F.size("digests") > 0)
    there = there.select("new_row", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "digests")
    inside = asked.groupBy("new_row", "bucket").cogroup(there.groupBy("new_row", "bucket")).applyInArrow(_compare, "row bigint, inside boolean")
    found = older.select("row", "new_id", (F.size("digests") == 0).alias("empty"), "path").join(inside, "row", "left")
    gone = found.where(F.coalesce("inside", F.col("empty") & ~F.col("path"))).select("row", F.col("new_id").alias("superseded_by"))
    out = rows.join(gone, "row", "left")
    return out.select("job_id", "session_id", F.when(F.col("superseded_by").isNotNull(), "coalesced").otherwise("pending").alias("state"), "superseded_by")


def branch(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, id, depth) from each leaf to its root by parent; a cycle ends where it would repeat.

    nodes: id, parent; of rows that share an id the one with the least parent counts.
    By doubling: a round knows the nodes up to 2^k steps up and every node's ancestor
    2^k steps up, so that a branch of a million nodes takes twenty rounds.
    """
    scratch = Scratch(nodes.sparkSession)
    own = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    jump = scratch.write(own.join(own.select(F.col("id").alias("up")), F.col("parent") == F.col("up")).select("id", "up"))
    rows = scratch.write(leaves.select("leaf").distinct().join(own.select("id"), F.col("leaf") == F.col("id")).select("leaf", "id", F.lit(0).alias("depth")))
    step, n = 1, rows.count()
    while True:
        higher = rows.join(jump, "id").select("leaf", F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        more = scratch.write(rows.unionByName(higher).groupBy("leaf", "id").agg(F.min("depth").alias("depth")))
        scratch.drop(rows)
        rows, before, n = more, n, more.count()
        if n == before:
            return rows
        further = scratch.write(jump.join(jump.select(F.col("id").alias("via"), F.col("up").alias("top")), F.col("up") == F.col("via")).select("id", F.col("top").alias("up")))
        scratch.drop(jump)
        jump, step = further, 2 * step
