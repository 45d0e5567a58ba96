"""Queue, transcripts and streams: events are jobs, conversations are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import capture as ca
from memlake.operators import machine
from memlake.operators import queue as qu
from memlake.plans.registry import query
from memlake.plans.views import EPOCH, NOW, columns_of, cte, table, view
from memlake.streaming import jobs as stream

_JOB = "concat(lower(host), '-', substr(sha256(concat_ws(':', lower(host), session_id, event, boundary)), 1, 16))"
_J = f"{cte('jobs')}, j AS (SELECT *, {_JOB} AS job_id FROM jobs)"


def jobs(spark, sf) -> DataFrame:
    return view(spark, sf, "jobs").withColumn("job_id", qu.job_id(*map(F.col, ("host", "session_id", "event", "boundary"))))


@query("job_id_dedup", f"WITH {_J}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, rowid) AS k FROM j) SELECT job_id, rowid, state FROM r WHERE k = 1")
def dedup(spark, sf):
    return qu.first_of_each(jobs(spark, sf)).select("job_id", "rowid", "state")


@query("tombstone_barrier", f"WITH {_J} SELECT count(*) AS n, count(DISTINCT job_id) AS jobs FROM j WHERE job_id NOT IN (SELECT job_id FROM j WHERE rowid % 11 = 0)")
def barrier(spark, sf):
    j = jobs(spark, sf)
    return qu.barred(j, j.where("rowid % 11 = 0").select("job_id")).agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


@query("active_reconcile", f"WITH {_J}, l AS (SELECT DISTINCT job_id FROM j WHERE state IN ('pending', 'processing')), i AS (SELECT DISTINCT job_id FROM j WHERE rowid % 5 = 0) SELECT job_id, 'added' AS change FROM l WHERE job_id NOT IN (SELECT job_id FROM i) UNION ALL SELECT job_id, 'removed' FROM i WHERE job_id NOT IN (SELECT job_id FROM l)")
def reconcile(spark, sf):
    j = jobs(spark, sf)
    return qu.reconcile(j, j.where("rowid % 5 = 0").select("job_id"))


@query("retry_schedule", f"WITH {_J} SELECT rowid, CASE WHEN attempt + 1 >= 3 THEN 'dead' ELSE 'pending' END AS next_state, CASE WHEN attempt + 1 < 3 THEN CAST({NOW} + pow(2, attempt + 1) * 5 AS BIGINT) END AS not_before FROM j WHERE state = 'processing'")
def retry(spark, sf):
    state, at = qu.retry(F.col("attempt"), F.lit(NOW))
    return jobs(spark, sf).where("state = 'processing'").select("rowid", state.alias("next_state"), at.cast("bigint").alias("not_before"))


@query("lease_expiry", f"WITH {_J} SELECT job_id, attempt, CASE WHEN attempt + 1 >= 3 THEN 'dead' ELSE 'pending' END AS next_state, CASE WHEN attempt + 1 < 3 THEN CAST({NOW} + pow(2, attempt + 1) * 5 AS BIGINT) END AS not_before FROM j WHERE state = 'processing' AND claimed_at < {NOW} - 300")
def lease(spark, sf):
    return qu.expired_leases(jobs(spark, sf), NOW).withColumn("not_before", F.col("not_before").cast("bigint"))


@query("ready_jobs", f"WITH {_J} SELECT job_id, rowid, created_at FROM j WHERE state = 'pending' AND not_before <= {NOW} ORDER BY created_at, job_id LIMIT 50")
def ready(spark, sf):
    return qu.ready(jobs(spark, sf), NOW).limit(50).select("job_id", "rowid", "created_at")


@query("prune_candidates", f"WITH {_J} SELECT rowid, job_id, state FROM j WHERE state IN ('completed', 'skipped') AND coalesce(updated_at, created_at) <= {NOW} - 2400000")
def prune(spark, sf):
    return qu.prunable(jobs(spark, sf), ["completed", "skipped"], 2400000, NOW).select("rowid", "job_id", "state")


@query("queue_status", f"WITH {_J}, s AS (SELECT unnest({list(qu.STATES)}) AS state) SELECT s.state, count(j.state) AS n FROM s LEFT JOIN j ON j.state = s.state GROUP BY s.state")
def status(spark, sf):
    return qu.status_counts(jobs(spark, sf))


_LEDGER = "SELECT session_id, user_id % 6 = 0 AS blocked FROM j WHERE user_id % 4 <> 3 GROUP BY ALL"


def _dead(spark, sf) -> DataFrame:
    j = jobs(spark, sf)
    ledger = j.where("user_id % 4 <> 3").selectExpr("session_id", "user_id % 6 = 0 AS blocked").distinct()
    return qu.audit_dead(qu.first_of_each(j), ledger, j.where("rowid % 10 = 0").select("job_id").distinct(), j.where("rowid % 23 = 0").select("job_id").distinct())


_AUDIT = f"""WITH {_J}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, rowid) AS r FROM j) WHERE r = 1), l AS ({_LEDGER}),
a AS (SELECT k.job_id, CASE WHEN k.job_id IN (SELECT job_id FROM j WHERE rowid % 23 = 0) THEN 'already_pruned' WHEN k.job_id IN (SELECT job_id FROM j WHERE rowid % 10 = 0) THEN 'already_processed' WHEN blocked IS NULL THEN 'no_ledger' WHEN blocked THEN 'identity_blocked' ELSE 'retryable' END AS decision FROM k LEFT JOIN l USING (session_id) WHERE state = 'dead')"""


@query("dead_audit", f"{_AUDIT} SELECT job_id, decision FROM a")
def dead_audit(spark, sf):
    return _dead(spark, sf)


@query("dead_histogram", f"{_AUDIT} SELECT decision, count(*) AS n FROM a GROUP BY decision")
def dead_histogram(spark, sf):
    return _dead(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


# --- captures and the life of a job --------------------------------------------


_HOST = "CASE event_id % 5 WHEN 0 THEN 'Codex' WHEN 1 THEN 'Pi' WHEN 2 THEN 'zcode' WHEN 3 THEN 'Antigravity' ELSE 'codex' END"
_RAW = """CASE WHEN event_id % 17 = 0 THEN 'not json' WHEN event_id % 19 = 0 THEN '{}' WHEN event_id % 5 = 0 THEN concat('{"session_id":"', CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('s', user_id) END, '","conversation_id":"c', user_id, '","hook_event_name":"SessionEnd","cwd":"/w/', user_id % 7, '"}')
 WHEN event_id % 5 = 1 THEN concat('{"sessionId":"p', user_id, '","event":"', CASE WHEN event_id % 3 = 0 THEN 'agent_settled' WHEN event_id % 3 = 1 THEN 'session_shutdown' ELSE 'other' END, '","session_file":"/t/', event_id, '"}')
 WHEN event_id % 5 = 2 THEN concat('{"session_id":"z', user_id, '","event":"SessionEnd","workspace_root":"/z"}')
 WHEN event_id % 5 = 3 THEN concat('{"conversationId":"a', user_id, '","workspacePaths":["/one"', CASE WHEN event_id % 2 = 0 THEN ',"/two"' ELSE '' END, '],"transcriptPath":"/t"}') ELSE '{"id":"only","transcript_file":"/f"}' END"""
_CAPTURES = f"SELECT event_id, {_HOST} AS host, {_RAW} AS raw, CASE WHEN event_id % 4 = 0 THEN '/env' END AS cwd, CAST(event_id % 400 AS STRING) AS boundary FROM events"


def _said(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(r, '$.{k}'), '')" for k in keys) + ")"


@query("capture_payloads", f"""WITH c AS ({_CAPTURES}), p AS (SELECT *, lower(host) AS h, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) ELSE CAST('{{}}' AS JSON) END AS r FROM c),
q AS (SELECT h AS host, boundary, CASE h WHEN 'codex' THEN coalesce({_said('session_id', 'conversation_id', 'id')}, 'unknown_session') WHEN 'pi' THEN coalesce({_said('session_id', 'sessionId')}, 'unknown_pi_session') WHEN 'zcode' THEN coalesce({_said('session_id', 'sessionId')}, 'unknown_zcode_session') ELSE coalesce({_said('conversationId', 'session_id')}, 'unknown_agy_session') END AS session_id,
 CASE h WHEN 'codex' THEN coalesce({_said('hook_event_name', 'event')}, 'Stop') WHEN 'pi' THEN CASE coalesce({_said('event')}, 'agent_settled') WHEN 'agent_settled' THEN 'Stop' WHEN 'session_shutdown' THEN 'SessionEnd' ELSE 'other' END ELSE 'Stop' END AS event,
 CASE h WHEN 'codex' THEN coalesce({_said('cwd', 'workspace_root')}, cwd, '') WHEN 'pi' THEN coalesce({_said('cwd', 'project_dir')}, cwd, '') WHEN 'zcode' THEN coalesce({_said('cwd', 'workspace_root')}, cwd, '') ELSE coalesce(CASE WHEN json_array_length(r, '$.workspacePaths') = 1 THEN json_extract_string(r, '$.workspacePaths[0]') END, cwd, '') END AS project_dir,
 CASE h WHEN 'codex' THEN {_said('transcript_path', 'transcript_file')} WHEN 'pi' THEN {_said('transcript_path', 'session_file')} WHEN 'zcode' THEN {_said('transcript_path', 'transcript_file')} ELSE {_said('transcriptPath', 'transcript_path')} END AS transcript_path FROM p)
SELECT concat(host, '-', substr(sha256(concat_ws(':', host, session_id, event, boundary)), 1, 16)) AS job_id, host, event, session_id, project_dir, transcript_path, boundary FROM q""")
def capture_payloads(spark, sf):
    return ca.payloads(table(spark, sf, "events").selectExpr(*columns_of(_CAPTURES)))


_PUBLISHED = """SELECT concat('j', event_id) AS name, CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN concat('{"job_id":"j', event_id, '","schema_version":2}') WHEN 3 THEN '{"job_id":"another"}' ELSE concat('{"job_id":"j', event_id, '","schema_version":1}') END AS payload,
 CASE event_id % 11 WHEN 0 THEN '{"state":"lost"}' WHEN 1 THEN '[1]' ELSE '{"state":"pending"}' END AS state FROM events"""


@query("queue_quarantine", f"WITH p AS ({_PUBLISHED.replace('FROM events', ', event_id FROM events')}) SELECT name, CASE event_id % 13 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'corrupt_payload' WHEN 2 THEN 'other_version' WHEN 3 THEN 'other_job' ELSE CASE WHEN event_id % 11 < 2 THEN 'corrupt_state' END END AS reason FROM p")
def quarantine(spark, sf):
    return ca.checked(table(spark, sf, "events").selectExpr(*columns_of(_PUBLISHED))).select("name", "reason")


#: Each user's events as the actions on one job.
_ACTIONS = f"SELECT concat('j', CAST(user_id AS STRING)) AS job_id, {EPOCH} + event_id * 37 AS moment, event_id AS seq, CASE event_id % 16 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'claim' WHEN 2 THEN 'claim' WHEN 3 THEN 'complete' WHEN 4 THEN 'skip' WHEN 5 THEN 'expire' WHEN 6 THEN 'retry' WHEN 7 THEN CASE WHEN event_id % 3 = 0 THEN 'prune' ELSE 'retry' END WHEN 8 THEN 'fail' WHEN 9 THEN 'fail' WHEN 10 THEN 'fail' WHEN 11 THEN 'claim' WHEN 12 THEN 'enqueue' WHEN 13 THEN 'claim' WHEN 14 THEN 'expire' ELSE 'retry' END AS action, event_id % 5 <> 0 AS retryable FROM events"
_FAILS = "(action = 'fail' OR action = 'expire' AND state = 'processing' AND moment - coalesce(claimed_at, 0) > 300)"
_FOLD = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, seq) AS k FROM ({_ACTIONS})),
r(job_id, k, state, attempt, not_before, claimed_at, tombstone) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM a UNION ALL
SELECT job_id, k, CASE WHEN action = 'enqueue' THEN CASE WHEN tombstone OR state IS NOT NULL THEN state ELSE 'pending' END WHEN state IS NULL THEN NULL WHEN action = 'claim' THEN CASE WHEN state = 'pending' AND not_before <= moment THEN 'processing' ELSE state END WHEN action = 'complete' THEN 'completed' WHEN action = 'skip' THEN 'skipped'
  WHEN {_FAILS} THEN CASE WHEN (action = 'expire' OR retryable) AND attempt + 1 < 3 THEN 'pending' ELSE 'dead' END WHEN action = 'retry' AND state IN ('dead', 'skipped') THEN 'pending' WHEN action = 'prune' AND state IN ('completed', 'skipped', 'coalesced', 'dead') THEN NULL ELSE state END,
 CASE WHEN action = 'enqueue' AND state IS NULL AND NOT tombstone THEN 0 WHEN state IS NULL THEN attempt WHEN {_FAILS} THEN attempt + 1 WHEN action = 'retry' AND state IN ('dead', 'skipped') THEN 0 ELSE attempt END,
 CASE WHEN action = 'enqueue' AND state IS NULL AND NOT tombstone THEN 0 WHEN state IS NULL THEN not_before WHEN {_FAILS} AND (action = 'expire' OR retryable) AND attempt + 1 < 3 THEN moment + CAST(5 * pow(2, attempt + 1) AS BIGINT) WHEN action = 'retry' AND state IN ('dead', 'skipped') THEN 0 ELSE not_before END,
 CASE WHEN action = 'enqueue' AND state IS NULL AND NOT tombstone THEN NULL WHEN state IS NULL THEN claimed_at WHEN action = 'claim' AND state = 'pending' AND not_before <= moment THEN moment WHEN action IN ('complete', 'skip') OR {_FAILS} OR action = 'retry' AND state IN ('dead', 'skipped') OR action = 'prune' AND state IN ('completed', 'skipped', 'coalesced', 'dead') THEN NULL ELSE claimed_at END,
 tombstone OR (action = 'prune' AND coalesce(state, '') IN ('completed', 'skipped', 'coalesced', 'dead')) FROM (SELECT r.job_id, a.k, r.state, r.attempt, r.not_before, r.claimed_at, r.tombstone, a.action, a.moment, a.retryable FROM r JOIN a ON a.job_id = r.job_id AND a.k = r.k + 1))
SELECT job_id, arg_max(coalesce(state, '-'), k) AS state, CAST(arg_max(attempt, k) AS INT) AS attempt, arg_max(not_before, k) AS not_before, nullif(arg_max(coalesce(claimed_at, -1), k), -1) AS claimed_at, arg_max(tombstone, k) AS tombstone, max(k) AS actions FROM r GROUP BY job_id"""


def _shown(states: DataFrame) -> DataFrame:
    return states.withColumn("state", F.coalesce("state", F.lit("-")))


@query("queue_states", _FOLD)
def queue_states(spark, sf):
    return _shown(machine.final_states(table(spark, sf, "events").selectExpr(*columns_of(_ACTIONS))))


@query("stream_queue_states", _FOLD)
def stream_queue_states(spark, sf):
    """The same by a stateful stream over the events file, run to its end."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return _shown(machine.latest(stream.run_available(spark, machine.follow(raw.selectExpr(*columns_of(_ACTIONS))), "update")))


# --- transcripts ---------------------------------------------------------------


@query("last_turns", f"WITH {cte('turns')} SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns) WHERE r <= 2")
def last_turns(spark, sf):
    return qu.last_turns(view(spark, sf, "turns"), 2).select("conv_id", "turn", "role")


_S = "regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')"


@query("last_goal", f"WITH {cte('turns')}, t AS (SELECT *, CASE WHEN role = 'user' AND turn = 4 THEN '/exit' ELSE {_S} END AS s FROM turns) SELECT conv_id, coalesce(arg_max(s, turn) FILTER (WHERE role = 'user' AND s <> '' AND lower(s) <> '/exit'), '') AS last_goal, coalesce(arg_max(s, turn) FILTER (WHERE role = 'assistant' AND s <> ''), '') AS last_reply FROM t GROUP BY conv_id")
def last_goal(spark, sf):
    said = F.when((F.col("role") == "user") & (F.col("turn") == 4), "/exit").otherwise(F.col("content"))
    return qu.goals(view(spark, sf, "turns").withColumn("content", said))


_DIFF = "concat('edit a/src/file', CAST(turn AS STRING), '.py and lib/x', CAST(conv_id % 5 AS STRING), '.ts ', content)"
_PATH = tx.FILE_PATH


@query("touched_files", f"WITH {cte('turns')}, f AS (SELECT conv_id, unnest(regexp_extract_all({_DIFF}, '{_PATH}')) AS p FROM turns), g AS (SELECT conv_id, p FROM f UNION SELECT conv_id, substr(p, 3) FROM f WHERE starts_with(p, 'a/') OR starts_with(p, 'b/')), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS r FROM g) SELECT conv_id, string_agg(p, ',' ORDER BY p) AS files FROM h WHERE r <= 30 GROUP BY conv_id")
def touched(spark, sf):
    found = view(spark, sf, "turns").select("conv_id", F.explode(tx.touched_files(F.expr(_DIFF))).alias("p")).distinct()
    return found.groupBy("conv_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("p")), 1, qu.MAX_FILES), ",").alias("files"))


@query("reply_pairs", f"WITH {cte('turns')}, t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM turns) SELECT conv_id, turn FROM t WHERE role = 'assistant' AND coalesce(nxt, 'user') = 'user'")
def reply_pairs(spark, sf):
    from pyspark.sql.window import Window

    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return view(spark, sf, "turns").withColumn("nxt", nxt).where((F.col("role") == "assistant") & (F.coalesce("nxt", F.lit("user")) == "user")).select("conv_id", "turn")


_NODES = "SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + greatest(0, turn - 1 - turn % 2) END AS parent FROM conversations"


@query("branch_walk", f"WITH RECURSIVE n AS ({_NODES}), l AS (SELECT CAST(max(id) AS BIGINT) AS leaf FROM n GROUP BY id // 100), w(leaf, id, parent, depth) AS (SELECT leaf, n.id, n.parent, 0 FROM l JOIN n ON n.id = l.leaf UNION ALL SELECT w.leaf, n.id, n.parent, w.depth + 1 FROM w JOIN n ON n.id = w.parent) SELECT leaf, id, depth FROM w")
def branch_walk(spark, sf):
    nodes = table(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS id", "CASE WHEN turn > 0 THEN conv_id * 100 + greatest(0, turn - 1 - turn % 2) END AS parent")
    return qu.branch(nodes, nodes.groupBy(F.floor(F.col("id") / 100)).agg(F.max("id").alias("leaf")).select("leaf"))


def _snapshots(spark, sf) -> DataFrame:
    """Of each conversation the whole, a prefix of two turns and one turn with other text."""
    t = view(spark, sf, "turns")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["content"])))
    whole = t.groupBy("conv_id").agg(turns.alias("all"))
    kinds = F.array(F.struct(F.lit(3).alias("k"), F.col("all").alias("turns")), F.struct(F.lit(1).alias("k"), F.slice("all", 1, 2).alias("turns")), F.struct(F.lit(2).alias("k"), F.array(F.lit("user:other")).alias("turns")))
    return whole.select("conv_id", F.explode(kinds).alias("s")).select((F.col("conv_id") * 10 + F.col("s.k")).alias("job_id"), F.col("conv_id").alias("session_id"), F.col("s.k").alias("created_at"), "s.turns")


@query("coalesce_sessions", "SELECT conv_id * 10 + k AS job_id, conv_id AS session_id, CASE WHEN k = 1 THEN 'coalesced' ELSE 'pending' END AS state FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([1, 2, 3]) AS k)")
def coalesced(spark, sf):
    return qu.coalesce_sessions(_snapshots(spark, sf)).drop("superseded_by")


#: Of a conversation, for two hosts and two users that share its session id: the whole, turns from the second on, the first two, other text, and nothing with and without a transcript; the second user's newest is the shortest.
_SNAPSHOTS = """SELECT conv_id * 100 + h * 40 + u * 20 + k AS job_id, CASE h WHEN 0 THEN 'codex' ELSE 'pi' END AS host, CAST(conv_id AS STRING) AS session_id, CASE WHEN conv_id % 11 = 3 AND k = 2 THEN NULL ELSE concat('u', CAST(u AS STRING)) END AS user_id, CASE WHEN conv_id % 5 = 1 AND k = 3 THEN 1 ELSE 0 END AS segment, CASE WHEN u = 1 THEN 10 - k ELSE k END AS created_at, CASE WHEN k = 5 THEN 'file' END AS transcript_path, k FROM {0}"""


@query("coalesce_captures", f"""WITH t AS (SELECT conv_id, list(concat(role, ':', trim(text)) ORDER BY turn, role, text) AS w FROM conversations GROUP BY conv_id),
c AS (SELECT c.*, CASE k WHEN 6 THEN w WHEN 3 THEN w[2:] WHEN 2 THEN w[:2] WHEN 1 THEN ['user:other'] ELSE [] END AS turns FROM ({_SNAPSHOTS.format("(SELECT *, unnest(range(7)) AS k FROM (SELECT *, unnest([0, 1]) AS u FROM (SELECT conv_id, unnest([0, 1]) AS h FROM t)))")}) c JOIN t ON CAST(t.conv_id AS VARCHAR) = session_id WHERE k > 0),
n AS (SELECT host, session_id, user_id, segment, arg_max(turns, (created_at, job_id)) AS w, arg_max(job_id, (created_at, job_id)) AS id FROM c WHERE user_id IS NOT NULL GROUP BY ALL),
j AS (SELECT c.*, n.id, CASE WHEN n.id IS NULL OR n.id = job_id THEN false WHEN len(turns) = 0 THEN transcript_path IS NULL ELSE len(list_filter(range(len(w) - len(turns) + 1), lambda i: w[i + 1:i + len(turns)] = turns)) > 0 END AS gone FROM c LEFT JOIN n USING (host, session_id, user_id, segment))
SELECT job_id, CASE WHEN gone THEN 'coalesced' ELSE 'pending' END AS state, CASE WHEN gone THEN id END AS superseded_by FROM j""")
def coalesced_captures(spark, sf):
    t = view(spark, sf, "turns")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.concat(x["role"], F.lit(":"), F.trim(x["content"])))
    whole = t.groupBy("conv_id").agg(turns.alias("w"))
    shape = whole.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("n")).selectExpr("conv_id", "n % 6 + 1 AS k", "n div 12 AS h", "n div 6 % 2 AS u")
    rows = spark.sql(_SNAPSHOTS.format("{m}"), m=shape)
    w, none = F.col("w"), F.array().cast("array<string>")
    held = F.when(F.col("k") == 6, w).when(F.col("k") == 3, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))).when(F.col("k") == 2, F.slice(w, 1, 2)).when(F.col("k") == 1, F.array(F.lit("user:other"))).otherwise(none)
    rows = rows.join(whole.select(F.col("conv_id").cast("string").alias("session_id"), "w"), "session_id").withColumn("turns", held)
    return qu.coalesce_sessions(rows).drop("session_id")


def _cursors(spark, sf) -> DataFrame:
    t = view(spark, sf, "turns")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    conv = t.groupBy("conv_id").agg(turns.alias("turns")).join(qu.goals(t), "conv_id")
    # a Stop and a SessionEnd of each session; the second ends with a shutdown command
    quit_ = F.concat("turns", F.array(F.struct(F.lit("user").alias("role"), F.lit("/exit").alias("content"))))
    both = conv.select("conv_id", "last_goal", "last_reply", F.explode(F.array(F.struct(F.lit("Stop").alias("event"), F.col("turns").alias("turns")), F.struct(F.lit("SessionEnd").alias("event"), quit_.alias("turns")))).alias("e"))
    cursor = qu.semantic_cursor(F.lit("p"), F.col("conv_id").cast("string"), F.col("last_goal"), F.col("last_reply"), F.array().cast("array<string>"), F.col("e.turns"))
    return both.select("conv_id", "e.event", cursor.alias("cursor"))


@query("semantic_cursor_dedup", "SELECT conv_id, 2 AS captures, 1 AS kept FROM (SELECT DISTINCT conv_id FROM conversations)")
def cursor_dedup(spark, sf):
    return _cursors(spark, sf).groupBy("conv_id").agg(F.count("*").cast("int").alias("captures"), F.count_distinct("cursor").cast("int").alias("kept"))


@query("semantic_cursor", f"WITH {cte('turns')}, t AS (SELECT conv_id, turn, role, {_S} AS s FROM turns), g AS (SELECT conv_id, coalesce(arg_max(s, turn) FILTER (WHERE role = 'user' AND s <> ''), '') AS goal, coalesce(arg_max(s, turn) FILTER (WHERE role = 'assistant' AND s <> ''), '') AS reply, substr(sha256(string_agg(concat(role, ':', s), chr(10) ORDER BY turn)), 1, 16) AS d FROM t GROUP BY conv_id) SELECT conv_id, sha256(concat('proj=p', chr(10), 'sess=', conv_id, chr(10), 'goal=', goal, chr(10), 'reply=', reply, chr(10), 'files=', chr(10), 'turns=', d)) AS cursor FROM g")
def cursors(spark, sf):
    return _cursors(spark, sf).where("event = 'Stop'").select("conv_id", "cursor")


# --- streams -------------------------------------------------------------------


@query("stream_job_dedup", f"WITH {_J} SELECT count(DISTINCT job_id) AS jobs FROM j")
def stream_dedup(spark, sf):
    """The same dedup by a stream over the events file, run to its end."""
    return stream.run_available(spark, stream.dedup_stream(stream.read_events(spark, sf))).agg(F.count("*").alias("jobs"))


@query("stream_job_state", f"WITH {_J} SELECT session_id, count(*) AS events, count(*) FILTER (WHERE state = 'dead') AS failures, max(rowid) AS last_event FROM j GROUP BY session_id")
def stream_state(spark, sf):
    """Per-session state kept by a stateful stream, run to its end."""
    return stream.latest_state(stream.run_available(spark, stream.session_state(stream.read_events(spark, sf))))


@query("ext_tumbling_window", "SELECT event_type, epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    """An extension, not an operation of the queue: watermarked windows over the events stream."""
    return stream.tumbling(table(spark, sf, "events"))


@query("ext_sliding_window", "SELECT epoch(s)::BIGINT AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY s")
def sliding(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("ext_session_window", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(DISTINCT k) AS sessions FROM s GROUP BY user_id")
def session_windows(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
