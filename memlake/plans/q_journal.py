"""Journaled operations, fences, pruning, and the agent's search route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import journal as jo
from memlake.operators.queue import first_of_each
from memlake.plans.q_queue import _J, jobs
from memlake.plans.registry import query
from memlake.plans.views import NOW, cte, view

_PLAN = "SELECT concat('op', id) AS operation_id, CASE WHEN doc_id % 9 = 0 THEN 'CONFLICT' ELSE 'EQUIVALENT' END AS relation, id AS winner_id, CAST(doc_id + 1 AS STRING) AS loser_id, CAST(doc_id AS STRING) AS winner_version, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE CAST(doc_id + 1 AS STRING) END AS loser_version FROM {0} WHERE doc_id % 2 = 0"


def _plans(spark, sf) -> DataFrame:
    mem = view(spark, sf, "mem")
    return spark.sql(_PLAN.format("{m}"), m=mem)


def _state(spark, sf) -> DataFrame:
    return view(spark, sf, "mem").where("doc_id % 50 <> 7").select("id", F.col("id").alias("version"), "status")


_OUT = f"""WITH {cte('mem')}, p AS ({_PLAN.format('mem')}), s AS (SELECT id, id AS version, coalesce(nullif(status, ''), 'active') AS status FROM mem WHERE doc_id % 50 <> 7),
o AS (SELECT p.*, CASE WHEN CAST(winner_id AS BIGINT) % 8 = 0 THEN 'already_applied' WHEN w.id IS NULL THEN 'winner_not_found' WHEN l.id IS NULL THEN 'loser_not_found' WHEN w.status = 'superseded' THEN 'winner_superseded' WHEN w.version <> winner_version THEN 'winner_changed' WHEN l.status = 'superseded' THEN 'loser_superseded' WHEN l.version <> loser_version THEN 'loser_changed' ELSE 'applied' END AS outcome FROM p LEFT JOIN s w ON w.id = winner_id LEFT JOIN s l ON l.id = loser_id)"""


def _journal(spark, sf) -> DataFrame:
    return _plans(spark, sf).where("cast(winner_id as bigint) % 8 = 0").select("operation_id", F.lit("applied").alias("status"))


@query("journal_outcomes", f"{_OUT} SELECT operation_id, outcome FROM o")
def outcomes(spark, sf):
    return jo.outcomes(_state(spark, sf), _plans(spark, sf), _journal(spark, sf)).select("operation_id", "outcome")


@query("journal_entries", f"{_OUT} SELECT relation, CASE WHEN outcome = 'applied' THEN 'applied' ELSE 'failed' END AS status, count(*) AS n FROM o WHERE outcome <> 'already_applied' GROUP BY ALL")
def entries(spark, sf):
    return jo.journal_rows(jo.outcomes(_state(spark, sf), _plans(spark, sf), _journal(spark, sf))).groupBy("relation", "status").agg(F.count("*").alias("n"))


@query("journal_second_run", f"{_OUT} SELECT count(*) AS applied_again FROM o WHERE false")
def second_run(spark, sf):
    first = jo.outcomes(_state(spark, sf), _plans(spark, sf), _journal(spark, sf))
    done = _journal(spark, sf).union(jo.journal_rows(first).where("status = 'applied'").select("operation_id", "status"))
    again = jo.outcomes(_state(spark, sf), _plans(spark, sf), done).where("outcome = 'applied'").join(done, "operation_id", "left_semi")
    return again.agg(F.count("*").alias("applied_again"))


@query("revert_guarded", f"WITH {cte('mem')} SELECT concat('op', id) AS operation_id, id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 50 <> 7 THEN coalesce(status, 'none') END AS restore_status, CASE WHEN doc_id % 50 = 7 THEN 'not_found' WHEN doc_id % 4 = 0 THEN 'changed_since' ELSE 'reverted' END AS outcome FROM mem WHERE doc_id % 3 = 0")
def revert(spark, sf):
    applied = view(spark, sf, "mem").where("doc_id % 3 = 0").select(F.concat(F.lit("op"), "id").alias("operation_id"), F.col("id").alias("loser_id"), F.coalesce("status", F.lit("none")).alias("pre_status"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("id")).alias("post_version"), F.lit("applied").alias("status"))
    return jo.revert_outcomes(_state(spark, sf), applied)


_SIG = "CASE WHEN event_id % 97 = 5 THEN 'other' ELSE 'own' END"


@query("session_fence", f"WITH c AS (SELECT user_id, event_id, {_SIG} AS sig, event_id % 211 = 3 AS refused FROM events), f AS (SELECT user_id, arg_min(sig, event_id) AS own FROM c GROUP BY user_id), b AS (SELECT c.user_id, min(event_id) AS cut_at FROM c JOIN f USING (user_id) WHERE refused OR sig <> own GROUP BY c.user_id), w AS (SELECT b.user_id, cut_at, CASE WHEN refused THEN 'CAPTURE_DISABLED' ELSE 'PROJECT_CONTEXT_CONFLICT' END AS why FROM b JOIN c ON c.user_id = b.user_id AND c.event_id = b.cut_at) SELECT c.user_id AS session_id, event_id AS seq, coalesce(event_id < cut_at, true) AS allowed, CASE WHEN event_id >= cut_at THEN why END AS blocked_by FROM c LEFT JOIN w USING (user_id)")
def session_fence(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS session_id", "event_id AS seq", f"{_SIG} AS signature", "event_id % 211 = 3 AS refused")
    return jo.fence(rows)


@query("prune_tombstones", f"WITH {_J}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, rowid) AS r FROM j) WHERE r = 1), g AS (SELECT rowid FROM k WHERE state IN ('completed', 'skipped') AND coalesce(updated_at, created_at) <= {NOW} - 2400000) SELECT (SELECT count(*) FROM g) AS tombstones, (SELECT count(*) FROM k WHERE rowid NOT IN (SELECT rowid FROM g)) AS left_over")
def prune(spark, sf):
    stones, left = jo.prune(first_of_each(jobs(spark, sf)), ["completed", "skipped"], 2400000, NOW)
    return stones.select(F.lit(1).alias("s")).union(left.select(F.lit(0).alias("s"))).agg(F.count_if(F.col("s") == 1).alias("tombstones"), F.count_if(F.col("s") == 0).alias("left_over"))


@query("edge_records", f"WITH {cte('mem')} SELECT id AS seed_id, CAST(doc_id + 1 AS STRING) AS neighbor_id, CASE WHEN doc_id % 50 = 7 THEN 'seed_missing' WHEN (doc_id + 1) % 50 = 7 OR doc_id + 1 NOT IN (SELECT doc_id FROM documents) THEN 'neighbor_missing' ELSE 'ok' END AS verdict FROM mem")
def edge_records(spark, sf):
    edges = view(spark, sf, "mem").selectExpr("id AS seed_id", "CAST(doc_id + 1 AS STRING) AS neighbor_id")
    return jo.edge_records(edges, _state(spark, sf))


@query("exact_cover", "SELECT count(*) AS n FROM labels")
def cover(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return jo.exact_cover(labels.select(F.col("doc_id").alias("sample_id"), "quality"), labels.select(F.col("doc_id").alias("sample_id"), "toxic")).agg(F.count("*").alias("n"))
