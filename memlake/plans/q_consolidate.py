"""Neighbours, arbitration, plans, application, write-side dedup and re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import consolidate as co
from memlake.operators import reindex
from memlake.plans.registry import query
from memlake.plans.views import cte, table, view
from memlake.scratch import Scratch

# between vectors of one label cosines stay low, so the registered threshold lies below the operator's default
_T, _K = 0.30, 10
_EDGES = f"""v AS (SELECT vec_id AS id, label AS identity, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e0 AS (SELECT a.id AS seed_id, b.id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.identity = b.identity AND a.id <> b.id),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, neighbor_id) AS k FROM e0 WHERE score >= {_T}) WHERE k <= {_K})"""


def edges(spark, sf) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), "embedding")
    return co.knn_edges(vectors, _K, _T)


@query("knn_edges", f"WITH {_EDGES} SELECT seed_id, neighbor_id, score FROM e")
def knn_edges(spark, sf):
    return edges(spark, sf)


@query("knn_edges_strict", f"WITH {_EDGES.replace(f'score >= {_T}', 'score >= 0.5')} SELECT seed_id, neighbor_id, score FROM e")
def knn_edges_strict(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), "embedding")
    return co.knn_edges(vectors, _K, 0.5)


@query("knn_pairs_dedup", f"WITH {_EDGES}, p AS (SELECT *, row_number() OVER (PARTITION BY least(seed_id, neighbor_id), greatest(seed_id, neighbor_id) ORDER BY score DESC, seed_id, neighbor_id) AS r FROM e) SELECT least(seed_id, neighbor_id) AS a, greatest(seed_id, neighbor_id) AS b, score FROM p WHERE r = 1")
def knn_pairs(spark, sf):
    return co.best_pairs(edges(spark, sf)).select("a", "b", "score")


_COLS = ("id", "memory", "source", "last_confirmed_at", "confirmation_count", "created_at", "user_id", "agent_id", "status", "updated_at")


def pairs(spark, sf) -> DataFrame:
    """Documents of equal text, in chains of neighbours by number: a pair for each copy with the one before it."""
    from pyspark.sql.window import Window

    # texts meet by their hash
    mem = view(spark, sf, "mem").select(*_COLS, "doc_id", F.sha2("memory", 256).alias("h"))
    prev = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    link = mem.select("h", "doc_id").withColumn("prev", prev).where("prev is not null")
    side = lambda s: mem.select(F.col("doc_id").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _COLS])
    return link.join(side("a"), F.col("prev") == F.col("n_a")).join(side("b"), F.col("doc_id") == F.col("n_b")).drop("h", "prev", "doc_id")


_PAIRS = f"""{cte('mem')}, lk AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY memory ORDER BY doc_id) AS prev FROM mem),
pr AS (SELECT {', '.join(f'a.{c} AS {c}_a, b.{c} AS {c}_b' for c in _COLS)} FROM lk JOIN mem a ON a.doc_id = lk.prev JOIN mem b ON b.doc_id = lk.doc_id)"""
_RANK = "CASE {0} WHEN 'agent_explicit' THEN 2 WHEN 'session_distillation' THEN 1 ELSE 0 END"
_ARB = f"""{_PAIRS}, ar0 AS (SELECT *, last_confirmed_at_a - last_confirmed_at_b AS gap, {_RANK.format('source_a')} AS ra, {_RANK.format('source_b')} AS rb, coalesce(confirmation_count_a, 1) AS ca, coalesce(confirmation_count_b, 1) AS cb FROM pr),
ar1 AS (SELECT *, CASE WHEN abs(gap) > 60 THEN 'recency' WHEN ra <> rb THEN 'authority' WHEN ca <> cb THEN 'confirmation' WHEN created_at_a <> created_at_b THEN 'stability_created_at' ELSE 'stability_id' END AS reason,
 CASE WHEN abs(gap) > 60 THEN gap > 0 WHEN ra <> rb THEN ra > rb WHEN ca <> cb THEN ca > cb WHEN created_at_a <> created_at_b THEN created_at_a < created_at_b ELSE id_a <= id_b END AS first FROM ar0),
arb AS (SELECT *, CASE WHEN first THEN id_a ELSE id_b END AS winner_id, CASE WHEN first THEN id_b ELSE id_a END AS loser_id FROM ar1)"""


@query("pair_preclassify", f"WITH {_PAIRS} SELECT id_a, id_b, CASE WHEN id_a = id_b OR trim(memory_a) = '' THEN 'DISTINCT' WHEN lower(regexp_replace(regexp_replace(memory_a, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) = lower(regexp_replace(regexp_replace(memory_b, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) THEN 'EQUIVALENT' END AS relation FROM pr")
def preclassify(spark, sf):
    c = F.col
    return pairs(spark, sf).select("id_a", "id_b", co.preclassify(c("id_a"), c("id_b"), c("memory_a"), c("memory_b")).alias("relation"))


@query("winner_arbitration", f"WITH {_ARB} SELECT id_a, id_b, winner_id, loser_id, reason FROM arb")
def arbitration(spark, sf):
    return co.arbitrate(pairs(spark, sf)).select("id_a", "id_b", "winner_id", "loser_id", "reason")


@query("winner_reasons", f"WITH {_ARB} SELECT reason, count(*) AS n FROM arb GROUP BY reason")
def reasons(spark, sf):
    return co.arbitrate(pairs(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


_VERSION = "substr(sha256(concat_ws('|', coalesce(CAST(updated_at_{0} AS VARCHAR), 'null'), md5(memory_{0}), coalesce(status_{0}, 'null'))), 1, 24)"
_SAME = "user_id_a = user_id_b AND agent_id_a = agent_id_b"


def _plan(spark, sf) -> DataFrame:
    c = F.col
    v = lambda s: co.version(c(f"updated_at_{s}"), F.md5(f"memory_{s}"), c(f"status_{s}"))
    decided = co.arbitrate(pairs(spark, sf)).where(_SAME).withColumn("va", v("a")).withColumn("vb", v("b"))
    first = c("winner_id") == c("id_a")
    decided = decided.withColumn("winner_version", F.when(first, c("va")).otherwise(c("vb"))).withColumn("loser_version", F.when(first, c("vb")).otherwise(c("va")))
    return decided.withColumn("operation_id", co.operation_id(c("user_id_a"), c("agent_id_a"), F.lit("EQUIVALENT"), c("winner_id"), c("loser_id"), c("winner_version"), c("loser_version")))


@query("operation_plan", f"WITH {_ARB}, v AS (SELECT *, {_VERSION.format('a')} AS va, {_VERSION.format('b')} AS vb FROM arb WHERE {_SAME}), w AS (SELECT *, CASE WHEN first THEN va ELSE vb END AS wv, CASE WHEN first THEN vb ELSE va END AS lv FROM v) SELECT winner_id, loser_id, wv AS winner_version, lv AS loser_version, substr(sha256(concat_ws('|', user_id_a, agent_id_a, 'EQUIVALENT', winner_id, loser_id, wv, lv)), 1, 20) AS operation_id FROM w")
def operation_plan(spark, sf):
    return _plan(spark, sf).select("winner_id", "loser_id", "winner_version", "loser_version", "operation_id")


@query("consolidation_stats", f"WITH {_ARB} SELECT count(*) AS pairs, count(*) FILTER (WHERE {_SAME}) AS same_identity, count(*) FILTER (WHERE NOT ({_SAME})) AS boundary_mismatch, count(*) FILTER (WHERE {_SAME} AND (coalesce(nullif(status_a, ''), 'active') = 'superseded' OR coalesce(nullif(status_b, ''), 'active') = 'superseded')) AS inactive FROM arb")
def consolidation_stats(spark, sf):
    same = (F.col("user_id_a") == F.col("user_id_b")) & (F.col("agent_id_a") == F.col("agent_id_b"))
    gone = (F.coalesce("status_a", F.lit("")) == "superseded") | (F.coalesce("status_b", F.lit("")) == "superseded")
    return pairs(spark, sf).agg(F.count("*").alias("pairs"), F.count_if(same).alias("same_identity"), F.count_if(~same).alias("boundary_mismatch"), F.count_if(same & gone).alias("inactive"))


@query("sequential_edges", f"""WITH RECURSIVE {_ARB}, o AS (SELECT CAST(id_a AS BIGINT) AS a, CAST(id_b AS BIGINT) AS b, CAST(winner_id AS BIGINT) AS winner_id, CAST(loser_id AS BIGINT) AS loser_id, row_number() OVER (ORDER BY CAST(id_a AS BIGINT), CAST(id_b AS BIGINT)) AS k FROM arb),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS dead, false AS taken UNION ALL SELECT o.k, CASE WHEN list_has_any(dead, [a, b]) THEN dead ELSE list_append(dead, loser_id) END, NOT list_has_any(dead, [a, b]) FROM w JOIN o ON o.k = w.k + 1)
SELECT a, b, winner_id, loser_id FROM o JOIN w USING (k) WHERE taken""")
def sequential(spark, sf):
    """Edges that take effect in order."""
    decided = co.arbitrate(pairs(spark, sf)).select(F.col("id_a").cast("bigint").alias("a"), F.col("id_b").cast("bigint").alias("b"), F.col("winner_id").cast("bigint").alias("winner_id"), F.col("loser_id").cast("bigint").alias("loser_id"))
    return co.first_edges(decided)


_APPLIED = f"""{_ARB}, lost AS (SELECT loser_id, min(winner_id) AS superseded_by FROM arb GROUP BY loser_id),
ap AS (SELECT mem.id, user_id, status AS old_status, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE status END AS status, superseded_by FROM mem LEFT JOIN lost ON lost.loser_id = mem.id)"""


def _applied(spark, sf) -> DataFrame:
    plan = co.arbitrate(pairs(spark, sf)).select("winner_id", "loser_id", F.lit("EQUIVALENT").alias("relation"))
    return co.apply_supersede(view(spark, sf, "mem"), plan)


@query("apply_then_active", f"WITH {_APPLIED} SELECT user_id, count(*) FILTER (WHERE coalesce(nullif(status, ''), 'active') <> 'superseded') AS active, count(superseded_by) AS superseded_now FROM ap GROUP BY user_id")
def apply_then_active(spark, sf):
    from memlake.operators.filters import active

    return _applied(spark, sf).groupBy("user_id").agg(F.count_if(active()).alias("active"), F.count("superseded_by").alias("superseded_now"))


@query("apply_idempotent", f"WITH {_APPLIED} SELECT id, status, superseded_by FROM ap")
def apply_twice(spark, sf):
    plan = co.arbitrate(pairs(spark, sf)).select("winner_id", "loser_id", F.lit("EQUIVALENT").alias("relation"))
    once = co.apply_supersede(view(spark, sf, "mem"), plan).drop("superseded_by", "merged_ids", "old_status")
    return co.apply_supersede(once, plan).select("id", "status", "superseded_by")


@query("revert_roundtrip", f"WITH {cte('mem')} SELECT id, status FROM mem")
def revert(spark, sf):
    return _applied(spark, sf).select("id", F.col("old_status").alias("status"))


@query("lineage_merge_disjoint", f"WITH {_ARB}, x AS (SELECT winner_id, loser_id, ca, cb, first, last_confirmed_at_a AS fa, last_confirmed_at_b AS fb, CASE WHEN first THEN ca ELSE cb END AS wc, CASE WHEN first THEN cb ELSE ca END AS lc FROM arb) SELECT winner_id, CAST(greatest(1, max(wc)) + sum(greatest(1, lc)) AS BIGINT) AS confirmation_count, array_to_string(list_sort(list_distinct(list(loser_id))), ',') AS merged_ids, max(greatest(fa, fb)) AS freshness FROM x GROUP BY winner_id")
def lineage(spark, sf):
    plan = co.arbitrate(pairs(spark, sf)).select("winner_id", "loser_id")
    members = view(spark, sf, "mem").select("id", co.confirmations(F.col("confirmation_count")).alias("count"), F.array().cast("array<string>").alias("merged_ids"), F.col("last_confirmed_at").alias("freshness"))
    return co.lineage_counts(members, plan).select("winner_id", F.col("confirmation_count").cast("bigint").alias("confirmation_count"), F.array_join("merged_ids", ",").alias("merged_ids"), "freshness")


_SPLIT = "doc_id % 2 = 0"


@query("dedup_insert", f"WITH {cte('mem')}, h AS (SELECT *, md5(memory) AS hash FROM mem) SELECT c.id FROM h c WHERE NOT ({_SPLIT}) AND NOT EXISTS (SELECT 1 FROM h e WHERE {_SPLIT.replace('doc_id', 'e.doc_id')} AND e.agent_id = c.agent_id AND coalesce(nullif(e.status, ''), 'active') <> 'superseded' AND (e.hash = c.hash OR regexp_replace(e.memory, '^\\s+|\\s+$', '', 'g') = regexp_replace(c.memory, '^\\s+|\\s+$', '', 'g')))")
def dedup_insert(spark, sf):
    # one user, so that copies meet in the same identity
    mem = view(spark, sf, "mem").withColumn("hash", F.md5("memory")).withColumn("user_id", F.lit("u"))
    return co.new_only(mem.where(f"not ({_SPLIT})"), mem.where(_SPLIT)).select("id")


_NOW = "CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE md5(memory) END"


@query("version_check", f"WITH {cte('mem')} SELECT CAST(doc_id // 50 AS BIGINT) AS batch, id, CASE WHEN doc_id % 19 = 0 THEN 'missing' WHEN coalesce(nullif(status, ''), 'active') = 'superseded' THEN 'superseded' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'ok' END AS verdict FROM mem")
def version_check(spark, sf):
    mem = view(spark, sf, "mem")
    observed = mem.select(F.floor(F.col("doc_id") / 50).alias("batch"), "id", F.md5("memory").alias("version"))
    return co.version_check(observed, mem.where("doc_id % 19 <> 0").select("id", F.expr(_NOW).alias("version"), "status"))


@query("version_aborted_batches", f"WITH {cte('mem')} SELECT CAST(doc_id // 3 AS BIGINT) AS batch, bool_or(doc_id % 19 = 0 OR coalesce(nullif(status, ''), 'active') = 'superseded' OR doc_id % 10 = 0) AS aborted FROM mem GROUP BY 1")
def aborted(spark, sf):
    mem = view(spark, sf, "mem")
    checked = co.version_check(mem.select(F.floor(F.col("doc_id") / 3).alias("batch"), "id", F.md5("memory").alias("version")), mem.where("doc_id % 19 <> 0").select("id", F.expr(_NOW).alias("version"), "status"))
    return checked.groupBy("batch").agg(F.bool_or(F.col("verdict") != "ok").alias("aborted"))


@query("stale_mutation", f"WITH {cte('mem')} SELECT id, coalesce(updated_at, created_at) > 1704200000 OR coalesce(nullif(status, ''), 'active') = 'superseded' AS stale FROM mem")
def stale(spark, sf):
    from memlake.operators.filters import active

    started = 1704200000
    return view(spark, sf, "mem").select("id", ((F.coalesce("updated_at", "created_at") > started) | ~active()).alias("stale"))


@query("entity_link_prune", f"WITH {cte('mem')}, t AS (SELECT id, unnest(regexp_extract_all(lower(memory), '[a-z]{{7,}}')) AS entity_id FROM mem) SELECT DISTINCT entity_id, id FROM t WHERE CAST(id AS BIGINT) % 7 <> 0")
def entity_prune(spark, sf):
    """Links of all entities as rows, however many memories name them."""
    mem = view(spark, sf, "mem")
    links = mem.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("memory"), F.lit("[a-z]{7,}"), F.lit(0)))).alias("entity_id"))
    return co.prune_link_rows(links, mem.where("doc_id % 7 = 0"))


_ACTION = "CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN doc_id % 13 = 0 THEN 'conflicted' WHEN doc_id % 6 = 0 THEN 'recompute' ELSE 'skipped' END"


def _collections(spark, sf) -> tuple[DataFrame, DataFrame]:
    mem = view(spark, sf, "mem")
    payload = F.struct("user_id", "agent_id", "status", F.md5("memory").alias("hash"))
    source = mem.select("id", payload.alias("payload"), F.lit("p2").alias("profile"))
    changed = F.struct("user_id", "agent_id", "status", F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.md5("memory")).alias("hash"))
    target = mem.where("doc_id % 10 <> 9").select("id", changed.alias("payload"), F.when(F.col("doc_id") % 6 == 0, "p1").otherwise("p2").alias("profile"))
    return source, target


def _classes(spark, sf) -> DataFrame:
    return co.reindex_classes(*_collections(spark, sf))


@query("reindex_classify", f"WITH {cte('mem')} SELECT id, {_ACTION} AS action FROM mem")
def reindex_classify(spark, sf):
    return _classes(spark, sf)


@query("reindex_verify", f"WITH {cte('mem')}, a AS (SELECT {_ACTION} AS action FROM mem) SELECT count(*) AS source_count, count(*) FILTER (WHERE action <> 'new') AS target_before, count(*) FILTER (WHERE action IN ('new', 'recompute')) AS written, count(*) FILTER (WHERE action = 'conflicted') AS conflicts, true AS counts_hold FROM a")
def reindex_verify(spark, sf):
    a = F.col("action")
    s = _classes(spark, sf).agg(F.count("*").alias("source_count"), F.count_if(a != "new").alias("target_before"), F.count_if(a.isin("new", "recompute")).alias("written"), F.count_if(a == "conflicted").alias("conflicts"), F.count_if(a == "new").alias("added"))
    return s.select("source_count", "target_before", "written", "conflicts", (F.col("target_before") + F.col("added") == F.col("source_count")).alias("counts_hold"))


@query("reindex_migrate", f"WITH {cte('mem')}, a AS (SELECT doc_id % 4 AS batch, {_ACTION} AS action FROM mem) SELECT CAST(batch AS INT) AS batch, count(*) FILTER (WHERE action IN ('new', 'recompute')) AS written, count(*) FILTER (WHERE action = 'skipped') AS skipped, count(*) FILTER (WHERE action = 'conflicted') AS conflicted FROM a GROUP BY batch")
def reindex_migrate(spark, sf):
    """All records in four batches, each verified after it was written."""
    source, target = _collections(spark, sf)
    ledger = reindex.migrate(source, target, F.col("id").cast("bigint") % 4, Scratch(spark).path())
    return ledger.select("batch", "written", "skipped", "conflicted")
