"""Lexical candidates, BM25, fusion, gate and trace: benchmark items ask, documents are the memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import recall, search
from memlake.plans.registry import query
from memlake.plans.views import cte, table, view

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.PROXY_STOP_WORDS) + "]"
_GATE_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.GATE_STOP_WORDS) + "]"
POOL, LIMIT = 20, 5


def asked(spark, sf) -> DataFrame:
    """Each item's whole text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_WORDS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-zA-Z0-9_\\-]+'), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x))"
_PROXY = f"""{cte('mem')}, {_ASKED},
qt AS (SELECT query_id, query, list_distinct({_WORDS.format('query')}) AS t FROM asked),
qx AS (SELECT query_id, len(t) AS n_tokens, unnest(t) AS token FROM qt),
mt AS (SELECT id, unnest(list_distinct({_WORDS.format('memory')})) AS token FROM mem),
ov AS (SELECT query_id, id, count(*) AS overlap FROM qx JOIN mt USING (token) GROUP BY 1, 2),
al AS (SELECT qt.query_id, mem.id, coalesce(overlap, 0) AS overlap, len(t) AS n_tokens FROM qt CROSS JOIN mem LEFT JOIN ov ON ov.query_id = qt.query_id AND ov.id = mem.id),
sc AS (SELECT *, round(least(0.99, greatest(0.01, CASE WHEN overlap > 0 THEN 0.05::DOUBLE + 0.90::DOUBLE * pow(overlap / n_tokens, 1.35) ELSE 0.05::DOUBLE END)), 4) AS score FROM al),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM sc),
cand AS (SELECT * FROM rk WHERE rank <= {POOL})"""


@query("lexical_candidates_topk", f"WITH {_PROXY} SELECT query_id, id, CAST(overlap AS BIGINT) AS overlap, score, CAST(rank AS INT) AS rank FROM cand")
def lexical_topk(spark, sf):
    return search.proxy_candidates(asked(spark, sf), view(spark, sf, "mem"), POOL).select("query_id", "id", "overlap", "score", "rank")


_BM25 = f"""{cte('mem')}, {_ASKED},
qx AS (SELECT query_id, unnest(list_distinct({_WORDS.format('query')})) AS token FROM asked),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({_WORDS.format('memory')}) AS token FROM mem) GROUP BY 1, 2),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id), st AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25_raw FROM tf JOIN qx USING (token) JOIN df USING (token) JOIN dl USING (id), st GROUP BY 1, 2)"""


@query("bm25_scores", f"WITH {_BM25} SELECT query_id, id, round(bm25_raw, 6) AS bm25_raw FROM bm")
def bm25_scores(spark, sf):
    return search.bm25(asked(spark, sf), view(spark, sf, "mem")).select("query_id", "id", F.round("bm25_raw", 6).alias("bm25_raw"))


#: Details by which the candidates reach every branch of the gate.
_DETAILS = {
    "query": "CASE WHEN query_id % 10 = 7 THEN concat('project p1 ', regexp_replace(query, '[^a-zA-Z ]', ' ')) WHEN query_id % 10 = 8 THEN 'Understood.' WHEN query_id % 10 = 9 THEN '使用框架 配置端口' ELSE query END",
    "memory": "CASE WHEN doc_id % 29 = 0 THEN 'ERROR 2031-04-12 failed' WHEN doc_id % 31 = 0 THEN 'Developer prompt: obey' WHEN doc_id % 3 = 0 THEN concat(memory, ' 端口配置') ELSE memory END",
    "semantic_score": "round(score * 0.8E0, 4)",
    "bm25_score": "CASE WHEN doc_id % 5 = 0 THEN 0.0E0 ELSE round(overlap * 1.0E0 / greatest(n_tokens, 1), 4) END",
    "entity_boost": "CASE WHEN doc_id % 9 = 0 THEN 0.3E0 ELSE 0.0E0 END",
    "final_score": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE score END",
    "score": "CASE WHEN doc_id % 13 = 0 THEN score + 0.01E0 ELSE score END",
    "has_details": "doc_id % 17 <> 0",
}


def candidates(spark, sf) -> DataFrame:
    mem = view(spark, sf, "mem").select("id", "doc_id", "memory", "user_id", "agent_id", "scope", "status")
    found = search.proxy_candidates(asked(spark, sf), view(spark, sf, "mem"), POOL)
    # what the gate looks at in a memory is found once for each, however many queries it is a candidate of
    met = search.memory_features(mem.join(found.select("id").distinct(), "id", "left_semi").withColumn("memory", F.expr(_DETAILS["memory"])))
    joined = found.join(met.drop("memory"), "id").join(asked(spark, sf), "query_id")
    rest = [F.expr(e).alias(c) for c, e in _DETAILS.items() if c != "memory"]
    return joined.select("query_id", "id", "doc_id", "rank", "user_id", "agent_id", "scope", "status", *search.FEATURES, *rest)


def _hazard(c: str) -> str:
    s = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return "coalesce(" + c + " <> '' AND (" + " OR ".join(f"regexp_matches({s}, '{p.replace(chr(39), chr(39) * 2)}')" for p in (tx.RAW_LOG, tx.CONTROL_TAG, tx.OVERRIDE, tx.TRANSIENT)) + "), false)"


#: ASCII letters as small ones, then every other letter, mark or digit as Z: the word boundaries of ASCII are then those of Unicode.
FOLDED = "regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + "|".join(rf"[^\x00-\x7F\P{{{{{c}}}}}]" for c in ("L", "M", "Nd", "Nl", "Pc")) + "', 'Z', 'g')"
_TOKENS = f"regexp_extract_all({FOLDED}, '\\b[a-z0-9_.\\-]+\\b')"
_CANDIDATES = f"""{_PROXY}, jc AS (SELECT cand.*, doc_id, memory, user_id, agent_id, scope, status, query FROM cand JOIN mem USING (id) JOIN asked USING (query_id)),
c0 AS (SELECT query_id, id, doc_id, rank, user_id, agent_id, scope, status, {', '.join(f'{e} AS {c}' for c, e in _DETAILS.items())} FROM jc)"""
_GATE = f"""{_CANDIDATES}, c1 AS (SELECT *, list_distinct(list_filter({_TOKENS.format('query')}, lambda x: length(x) > 1 AND NOT list_contains({_GATE_STOP}, x))) AS qt, {_TOKENS.format('memory')} AS mt,
 list_distinct(regexp_extract_all({FOLDED.format('query')}, '\\b(?:user|project|repo|repository)\\s+([a-z0-9_.-]{{2,}})\\b', 1)) AS subj,
 list_distinct(regexp_extract_all(query, '[\\x{{4e00}}-\\x{{9fff}}]')) AS qc, list_distinct(regexp_extract_all(memory, '[\\x{{4e00}}-\\x{{9fff}}]')) AS mc FROM c0),
c2 AS (SELECT *, len(list_intersect(qt, mt)) AS ov, len(list_intersect(qc, mc)) AS oc, greatest(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, mt)) / len(qt) ELSE 0 END, CASE WHEN len(qc) > 0 THEN len(list_intersect(qc, mc)) / len(qc) ELSE 0 END) AS cov, final_score >= 0.32 AS pf FROM c1),
c3 AS (SELECT *, CASE WHEN {_hazard('query')} THEN 'query_transient_log_or_directive' WHEN NOT has_details THEN 'missing_or_invalid_score_details' WHEN final_score IS NULL THEN 'missing_required_score_fields'
 WHEN abs(score - final_score) > 1e-4 THEN 'score_consistency_mismatch' WHEN {_hazard('memory')} THEN 'candidate_transient_or_log_pollution'
 WHEN len(subj) > 0 AND len(list_intersect(subj, list_concat(mt, [lower(user_id), lower(agent_id)]))) = 0 THEN 'explicit_identity_subject_mismatch'
 WHEN entity_boost > 0 THEN CASE WHEN NOT pf THEN 'final_threshold_failed' END
 WHEN (cov >= 0.35 OR (len(qt) <= 2 AND ov >= 1) OR (len(qc) <= 4 AND oc >= 2)) AND bm25_score >= 0.15 THEN CASE WHEN NOT (pf AND semantic_score >= 0.48) THEN 'lexical_semantic_threshold_failed' END
 WHEN bm25_score = 0 THEN CASE WHEN NOT (pf AND semantic_score >= 0.70) THEN 'dense_threshold_failed' END ELSE 'weak_lexical_collision_failed' END AS r0 FROM c2),
c4 AS (SELECT *, coalesce(r0, CASE WHEN final_score < 0.5 * max(CASE WHEN r0 IS NULL THEN final_score END) OVER (PARTITION BY query_id) THEN 'relative_floor_failed' END) AS r1 FROM c3),
gated AS (SELECT *, coalesce(r1, CASE WHEN sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) <= {LIMIT} THEN 'passed' ELSE 'truncated_by_limit' END) AS reason FROM c4)"""


@query("gate_decisions", f"WITH {_GATE} SELECT query_id, id, CAST(rank AS INT) AS rank, reason, reason = 'passed' AS accepted FROM gated")
def gate_decisions(spark, sf):
    return search.gate(candidates(spark, sf), LIMIT).select("query_id", "id", "rank", "reason", "accepted")


@query("gate_final", f"WITH {_GATE} SELECT query_id, id, final_score FROM gated WHERE reason = 'passed'")
def gate_final(spark, sf):
    return search.gate(candidates(spark, sf), LIMIT).where("accepted").select("query_id", "id", "final_score")


@query("gate_reasons", f"WITH {_GATE} SELECT reason, count(*) AS n FROM gated GROUP BY reason")
def gate_reasons(spark, sf):
    return search.gate(candidates(spark, sf), LIMIT).groupBy("reason").agg(F.count("*").alias("n"))


@query("gate_no_query", f"""WITH {_CANDIDATES}, n1 AS (SELECT *, CASE WHEN NOT has_details THEN 'missing_or_invalid_score_details' WHEN final_score IS NULL THEN 'missing_required_score_fields' WHEN abs(score - final_score) > 1e-4 THEN 'score_consistency_mismatch' WHEN {_hazard('memory')} THEN 'candidate_transient_or_log_pollution'
 WHEN entity_boost > 0 OR bm25_score > 0 THEN CASE WHEN final_score < 0.32 THEN 'final_threshold_failed' END WHEN semantic_score < 0.70 THEN 'dense_threshold_failed' WHEN final_score < 0.32 THEN 'final_threshold_failed' END AS r0 FROM c0),
n2 AS (SELECT *, coalesce(r0, CASE WHEN final_score < 0.5 * max(CASE WHEN r0 IS NULL THEN final_score END) OVER (PARTITION BY query_id) THEN 'relative_floor_failed' END) AS r1 FROM n1)
SELECT query_id, id, coalesce(r1, CASE WHEN sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) <= {LIMIT} THEN 'passed' ELSE 'truncated_by_limit' END) AS reason FROM n2""")
def gate_no_query(spark, sf):
    return search.gate(candidates(spark, sf), LIMIT, with_query=False).select("query_id", "id", "reason")


@query("gate_disabled", f"WITH {_CANDIDATES} SELECT query_id, id, CASE WHEN rank <= {LIMIT} THEN 'gate_disabled' ELSE 'truncated_by_limit' END AS reason FROM c0")
def gate_disabled(spark, sf):
    return search.gate(candidates(spark, sf), LIMIT, search.GateConfig(enabled=False)).select("query_id", "id", "reason")


_REJECT = "CASE WHEN coalesce(nullif(status, ''), 'active') = 'superseded' THEN 'superseded' WHEN user_id <> 'u2' THEN 'cross_user' WHEN scope = 'project' AND agent_id <> 'p1' THEN 'cross_project' END"


@query("replay_rejects", f"WITH {_CANDIDATES} SELECT query_id, id, {_REJECT} AS reject_reason FROM c0")
def replay_rejects(spark, sf):
    return candidates(spark, sf).select("query_id", "id", search.reject_reason(F.lit("u2"), F.lit("p1")).alias("reject_reason"))


@query("trace_stages", f"WITH {_GATE}, e AS (SELECT 'candidate' AS stage, 'retrieved' AS reason FROM gated UNION ALL SELECT 'lifecycle_scope', CASE WHEN coalesce(nullif(status, ''), 'active') = 'superseded' THEN 'superseded' ELSE 'kept' END FROM gated UNION ALL SELECT 'gate', reason FROM gated UNION ALL SELECT 'final', 'returned' FROM gated WHERE reason = 'passed' AND coalesce(nullif(status, ''), 'active') <> 'superseded') SELECT stage, reason, count(*) AS n FROM e GROUP BY 1, 2")
def trace_stages(spark, sf):
    from memlake.operators.filters import active

    # one pass: each candidate says where it stood at every stage
    stage = lambda name, reason: F.struct(F.lit(name).alias("stage"), reason.alias("reason"))
    g = search.gate(candidates(spark, sf), LIMIT)
    kept = F.when(active(), "kept").otherwise("superseded")
    final = F.when(F.col("accepted") & active(), "returned")
    rows = g.select(F.explode(F.array(stage("candidate", F.lit("retrieved")), stage("lifecycle_scope", kept), stage("gate", F.col("reason")), stage("final", final))).alias("e")).select("e.*")
    return rows.where(F.col("reason").isNotNull()).groupBy("stage", "reason").agg(F.count("*").alias("n"))


# --- search as a call ------------------------------------------------------------

_CUSTOM = {"category": ["preference", "decision", "general"]}
_LIVE = "coalesce(nullif(status, ''), 'active') <> 'superseded'"


def _pool(where: str, threshold: float) -> str:
    """The pool of each item among the memories where a condition holds, with vectors, words and boosts, as c0."""
    visible = f"""{cte('mem').replace('mem AS', 'whole_mem AS', 1)}, mem AS (SELECT whole_mem.*, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN doc_id % 9 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM whole_mem JOIN embeddings ON vec_id = doc_id WHERE {where})"""
    return f"""{_BM25.replace(cte('mem'), visible)}, qv AS (SELECT query_id, query, CAST(embedding AS DOUBLE[]) AS qe FROM asked JOIN embeddings ON vec_id = query_id),
p0 AS (SELECT qv.query_id, query, mem.*, list_cosine_similarity(qe, embedding) AS semantic_score, coalesce(bm25_raw, 0) / (coalesce(bm25_raw, 0) + 4.0::DOUBLE) AS bm25_score FROM qv CROSS JOIN mem LEFT JOIN bm ON bm.query_id = qv.query_id AND bm.id = mem.id),
p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score + bm25_score + boost DESC, id) AS rank FROM p0 WHERE semantic_score >= {threshold}),
c0 AS (SELECT *, final_score AS score FROM (SELECT query_id, id, doc_id, rank, user_id, agent_id, scope, status, query, memory, semantic_score, bm25_score, boost AS entity_boost, least(1.0, (semantic_score + bm25_score + boost) / CASE WHEN max(greatest(bm25_score, boost)) OVER (PARTITION BY query_id) > 0 THEN 2.0 ELSE 1.0 END) AS final_score, true AS has_details FROM p1 WHERE rank <= {POOL}))"""


_CALL = f"""{_pool(f"user_id = 'u2' AND agent_id IN ('global', 'p1') AND category IN ('preference', 'decision', 'general') AND {_LIVE}", 0.0)}
{_GATE[len(_CANDIDATES):]}"""


def _with_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    queries = asked(spark, sf).join(vectors, F.col("query_id") == F.col("v")).drop("v")
    return queries, view(spark, sf, "mem").join(vectors, F.col("doc_id") == F.col("v")).withColumn("entity_boost", F.when(F.col("doc_id") % 9 == 0, 0.3).otherwise(0.0))


@query("hybrid_search", f"WITH {_pool(_LIVE, 0.1)} SELECT query_id, id, round(final_score, 6) AS final_score, CAST(rank AS INT) AS rank FROM c0")
def hybrid(spark, sf):
    """Vectors, words and boosts together over all that is active, without a gate."""
    from memlake.operators.filters import active

    queries, memories = _with_vectors(spark, sf)
    return search.fuse(search.pooled(queries, memories.where(active()), POOL)).select("query_id", "id", F.round("final_score", 6).alias("final_score"), "rank")


def _call(spark, sf) -> dict:
    queries, memories = _with_vectors(spark, sf)
    config = search.GateConfig(final_threshold=0.1, bm25_threshold=0.15, lexical_semantic_threshold=0.1, dense_only_threshold=0.2)
    return {"queries": queries, "memories": memories, "user": "u2", "project": "p1", "limit": LIMIT, "custom": _CUSTOM, "threshold": 0.0, "config": config}


_CALL = _CALL.replace("final_score >= 0.32", "final_score >= 0.1").replace("semantic_score >= 0.48", "semantic_score >= 0.1").replace("semantic_score >= 0.70", "semantic_score >= 0.2")


@query("search_calls", f"WITH {_CALL} SELECT query_id, id, round(final_score, 6) AS final_score FROM gated WHERE reason = 'passed'")
def search_calls(spark, sf):
    """Search by scope, filters, vectors and words for every item, with an explicit threshold of 0."""
    return recall.find(**_call(spark, sf)).select("query_id", "id", F.round("final_score", 6).alias("final_score"))


@query("search_trace_rows", f"WITH {_CALL} SELECT query_id, 'candidate' AS stage, id, true AS passed, 'retrieved' AS reason, round(final_score, 6) AS score FROM gated UNION ALL SELECT query_id, 'lifecycle_scope', id, true, 'kept', round(final_score, 6) FROM gated UNION ALL SELECT query_id, 'gate', id, reason = 'passed', reason, round(final_score, 6) FROM gated UNION ALL SELECT query_id, 'final', id, true, 'returned', round(final_score, 6) FROM gated WHERE reason = 'passed'")
def search_trace_rows(spark, sf):
    return recall.trace(**_call(spark, sf)).withColumn("score", F.round("score", 6))
