"""Records, identifiers, model output and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import decisions as de
from memlake.operators import records as rc
from memlake.plans.registry import query
from memlake.plans.views import cte, literal_cte, table, view

# --- projections and writes ------------------------------------------------------


def _points(spark, sf) -> DataFrame:
    m = view(spark, sf, "mem")
    payload = F.map_filter(F.create_map(*[x for k, c in (("data", F.md5("memory")), ("user_id", F.col("user_id")), ("agent_id", F.col("agent_id")), ("category", F.col("category")), ("status", F.col("status"))) for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    return m.select("id", "doc_id", payload.alias("payload"))


@query("payload_records", f"WITH {cte('mem')} SELECT id, md5(memory) AS memory, user_id, agent_id, category, status FROM mem")
def payload_records(spark, sf):
    return rc.record(_points(spark, sf)).select("id", "memory", "user_id", "agent_id", F.col("metadata")["category"].alias("category"), F.col("metadata")["status"].alias("status"))


@query("metadata_update", f"WITH {cte('mem')} SELECT id, CASE WHEN doc_id % 3 = 0 THEN concat('new ', id) ELSE md5(memory) END AS memory, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE category END AS category, CASE WHEN doc_id % 3 = 0 THEN 'x' END AS tag, status FROM mem")
def metadata_update(spark, sf):
    rows = rc.record(_points(spark, sf)).select("id", "memory", "metadata")
    patch = F.create_map(F.lit("tag"), F.lit("x"), F.lit("category"), F.lit(None).cast("string"))
    patches = view(spark, sf, "mem").where("doc_id % 3 = 0").select("id", F.concat(F.lit("new "), "id").alias("memory"), patch.alias("metadata"))
    m = F.col("metadata")
    return rc.update(rows, patches).select("id", "memory", m["category"].alias("category"), m["tag"].alias("tag"), m["status"].alias("status"))


@query("delete_scope", f"WITH {cte('mem')} SELECT count(*) AS n FROM mem WHERE NOT (user_id = 'u2' AND agent_id = 'p1') AND doc_id % 17 <> 0")
def delete_scope(spark, sf):
    mem = view(spark, sf, "mem")
    return rc.delete(mem, mem.where("(user_id = 'u2' and agent_id = 'p1') or doc_id % 17 = 0")).agg(F.count("*").alias("n"))


@query("history_append", f"WITH {cte('hist')} SELECT event, count(*) AS n FROM hist WHERE rowid % 2 = 0 OR CAST(memory_id AS BIGINT) % 10 <> 0 GROUP BY event")
def history_append(spark, sf):
    h = view(spark, sf, "hist")
    skipped = h.select(F.col("memory_id").alias("id")).where("cast(id as bigint) % 10 = 0")
    return rc.append_history(h.where("rowid % 2 = 0"), h.where("rowid % 2 <> 0"), skipped).groupBy("event").agg(F.count("*").alias("n"))


@query("conversation_builder", f"WITH {cte('turns')} SELECT conv_id, count(*) + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN conv_id % 2 = 0 THEN 'assistant' ELSE arg_max(role, turn) END AS last_role FROM turns GROUP BY conv_id")
def conversation_builder(spark, sf):
    by = view(spark, sf, "turns").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    c = rc.conversation(F.col("m"), F.when(F.col("conv_id") % 2 == 0, "and so on"))
    return by.select("conv_id", c.alias("c")).select("conv_id", F.size("c").cast("bigint").alias("n"), F.element_at("c", -1)["role"].alias("last_role"))


@query("logical_ids", f"WITH {cte('mem')} SELECT id, CASE WHEN doc_id % 4 = 0 THEN concat('b', id) WHEN doc_id % 4 = 1 THEN concat('o', id) WHEN doc_id % 4 = 2 AND doc_id % 5 = 0 THEN concat('m', id) ELSE id END AS logical_id FROM mem")
def logical_ids(spark, sf):
    mem = view(spark, sf, "mem")
    mapped = mem.where("doc_id % 5 = 0").select("id", F.concat(F.lit("m"), "id").alias("mapped"))
    meta = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("b"), "id")).when(F.col("doc_id") % 4 == 1, "")
    own = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("o"), "id"))
    third = F.when(F.col("doc_id") % 4 == 2, F.col("mapped"))
    return mem.join(mapped, "id", "left").select("id", rc.logical_id(meta, own, third, F.col("id")).alias("logical_id"))


# --- identifiers -----------------------------------------------------------------


@query("namespace_binding", "SELECT source AS anchor, CASE WHEN source LIKE 'src1%' THEN concat('ns-', source) ELSE concat('repo_', sha256(source)) END AS namespace FROM documents GROUP BY source")
def namespace_binding(spark, sf):
    anchors = table(spark, sf, "documents").select(F.col("source").alias("anchor")).distinct()
    return rc.namespace(anchors, anchors.where("anchor like 'src1%'").select("anchor", F.concat(F.lit("ns-"), "anchor").alias("namespace")))


_CANDS = [(1, "a", False), (1, "a", False), (2, "a", True), (2, "b", False), (3, "a", False), (3, "b", False), (4, "a", True), (4, "b", True)]


@query("root_agreement", f"WITH {literal_cte('c', 'request, anchor, is_root', _CANDS)}, g AS (SELECT request, count(DISTINCT anchor) AS n, min(anchor) AS one, count(DISTINCT CASE WHEN is_root THEN anchor END) AS r, min(CASE WHEN is_root THEN anchor END) AS root FROM c GROUP BY request) SELECT request, CASE WHEN n = 1 THEN one WHEN r = 1 THEN root END AS anchor, CASE WHEN n = 1 THEN 'agreed' WHEN r = 1 THEN 'root' ELSE 'ambiguous' END AS verdict FROM g")
def root_agreement(spark, sf):
    return rc.agreed_anchor(spark.createDataFrame(_CANDS, "request int, anchor string, is_root boolean"))


_PROFILES = [("vertexai", "gemini-embedding-2", 768), ("OpenAI", "text.embedding/3-large!", 3072)]


@query("collection_names", f"WITH {literal_cte('p', 'provider, model, dimensions', _PROFILES)} SELECT model, concat_ws('_', 'memories', lower(provider), lower(regexp_replace(regexp_replace(string_split(model, '/')[-1], '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), CAST(dimensions AS VARCHAR)) AS name FROM p")
def collection_names(spark, sf):
    return spark.createDataFrame(_PROFILES, "provider string, model string, dimensions int").select("model", rc.collection_name(F.col("provider"), F.col("model"), F.col("dimensions")).alias("name"))


@query("epoch_to_iso", f"WITH {cte('jobs')} SELECT rowid, CASE WHEN created_at * (rowid % 5 - 1) > 0 THEN strftime(make_timestamp(created_at * (rowid % 5 - 1) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM jobs")
def epoch_iso(spark, sf):
    return view(spark, sf, "jobs").select("rowid", rc.iso_time(F.col("created_at") * (F.col("rowid") % 5 - 1)).alias("iso"))


@query("embedding_prompts", "SELECT item_id, md5(concat(CASE WHEN item_id % 2 = 0 THEN 'task: search result | query: ' ELSE 'title: none | text: ' END, text)) AS prompt_md5 FROM benchmark")
def prompts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(rc.prompt(F.col("text"), F.when(F.col("item_id") % 2 == 0, "search").otherwise("add"))).alias("prompt_md5"))


_WORD_SUMS = ", ".join(f"CAST(coalesce(sum(CAST(concat('0x', substr(d, {8 * k + 1}, 8)) AS BIGINT)), 0) AS VARCHAR)" for k in range(8))


@query("dataset_hash", f"WITH d AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), text)) AS d FROM documents) SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_WORD_SUMS})) AS dataset_hash FROM d")
def dataset_hash(spark, sf):
    return rc.dataset_hash(table(spark, sf, "documents"), "doc_id", "text")


@query("hash_embeddings")
def hash_embeddings(spark, sf):
    """The stand-in embedder over the benchmark items, by the batched model seam."""
    return rc.with_embedding(table(spark, sf, "benchmark").select("item_id", "text"), "text", rc.HashEmbedder(16)).select("item_id", "embedding")


@query("hypotheses_jsonl", "SELECT concat('{\"question_id\":\"q', item_id, '\",\"hypothesis\":\"a', item_id, '\"}') AS value FROM benchmark")
def hypotheses(spark, sf):
    return rc.hypotheses(table(spark, sf, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("question_id"), F.concat(F.lit("a"), "item_id").alias("hypothesis")))


# --- model output ----------------------------------------------------------------

_VERDICTS = [(1, '{"relation":"EQUIVALENT","confidence":0.9}'), (2, '{"relation":"CONFLICT","confidence":0.5}'), (3, 'Sure: {"relation":"DISTINCT","confidence":1}'), (4, '{"relation":"SAME","confidence":1}'), (5, '{"relation":"CONFLICT","confidence":2}'), (6, None), (7, '{"relation":"CONFLICT","confidence":"high"}'), (8, '{"relation":"DISTINCT","confidence":0.6}')]
_WANT = [(1, "EQUIVALENT", 0.9, "classified"), (2, "DISTINCT", 0.0, "low_confidence"), (3, "DISTINCT", 0.0, "malformed_classifier_output"), (4, "DISTINCT", 0.0, "malformed_classifier_output"), (5, "DISTINCT", 0.0, "malformed_classifier_output"), (6, "DISTINCT", 0.0, "classifier_exception"), (7, "DISTINCT", 0.0, "malformed_classifier_output"), (8, "DISTINCT", 0.6, "classified")]


@query("verdict_decisions", f"WITH {literal_cte('v', 'k, relation, confidence, reason', _WANT)} SELECT k, relation, CAST(confidence AS DOUBLE) AS confidence, reason FROM v")
def verdicts(spark, sf):
    rows = [(k, f"a{k}", f"b{k}", "x", "y", "u", "u", "p", "p", None, None, v) for k, v in _VERDICTS]
    cols = "k int, id_a string, id_b string, text_a string, text_b string, user_id_a string, user_id_b string, agent_id_a string, agent_id_b string, status_a string, status_b string, verdict string"
    return de.decide(spark.createDataFrame(rows, cols)).select("k", "relation", "confidence", "reason")


@query("decider_reasons", f"WITH {cte('mem')}, p AS (SELECT a.*, b.id AS idb, b.user_id AS ub, b.agent_id AS ab, b.status AS sb, b.memory AS mb FROM mem a JOIN mem b ON b.doc_id = a.doc_id + 15) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN user_id <> ub OR agent_id <> ab THEN 'identity_boundary_mismatch' WHEN coalesce(status, '') = 'superseded' OR coalesce(sb, '') = 'superseded' THEN 'inactive_memory' WHEN lower(regexp_replace(trim(memory), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(mb), '\\s+', ' ', 'g')) THEN 'normalized_equal' ELSE 'classifier_exception' END AS reason FROM p) GROUP BY reason")
def decider(spark, sf):
    m = view(spark, sf, "mem")
    side = lambda s: m.select((F.col("doc_id") - (15 if s == "b" else 0)).alias("n"), F.col("id").alias(f"id_{s}"), F.col("memory").alias(f"text_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("user_id", "agent_id", "status")])
    pairs = side("a").join(side("b"), "n").withColumn("verdict", F.lit(None).cast("string"))
    return de.decide(pairs).groupBy("reason").agg(F.count("*").alias("n"))


_EXTRACTIONS = [(1, '{"memory":[{"text":"a"}]}', None), (2, "", "empty_response"), (3, "no", "invalid_json"), (4, '{"x":1}', "invalid_schema"), (5, '{"memory":[{"text":""}]}', "invalid_schema"), (6, '{"memory":[]}', None)]


@query("extraction_errors", f"WITH {literal_cte('e', 'k, body, error', _EXTRACTIONS)} SELECT k, error FROM e")
def extraction_errors(spark, sf):
    return spark.createDataFrame(_EXTRACTIONS, "k int, body string, error string").select("k", de.extraction_error(F.col("body")).alias("error"))


_P = "round(0.34E0 + (doc_id * 37 % 660) / 1000.0E0, 4)"
_CHOICE = f"s AS (SELECT doc_id, {_P} AS p, round((1 - {_P}) * 0.7E0, 6) AS p2, CASE WHEN quality = 1 AND toxic = 0 THEN 'EQUIVALENT' WHEN quality = 1 THEN 'CONFLICT' ELSE 'DISTINCT' END AS best FROM labels)"


_TOP = "CASE WHEN p >= p2 THEN best WHEN best = 'EQUIVALENT' THEN 'CONFLICT' ELSE 'EQUIVALENT' END"


@query("takeover_thresholds", f"WITH {_CHOICE}, x AS (SELECT {_TOP} AS top, greatest(p, p2) AS t, round(greatest(p, p2) - CASE WHEN p >= p2 THEN p2 ELSE greatest(p, 1 - p - p2) END, 6) AS margin FROM s) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN margin <= 1e-5 THEN 'tie' WHEN top = 'EQUIVALENT' AND t < 0.8 OR top = 'CONFLICT' AND t < 0.75 THEN 'probability_below_floor' WHEN top = 'EQUIVALENT' AND margin < 0.25 OR top = 'CONFLICT' AND margin < 0.2 THEN 'margin_below_floor' ELSE 'accepted' END AS reason FROM x) GROUP BY reason")
def takeover(spark, sf):
    rows = table(spark, sf, "labels").selectExpr("doc_id", f"{_P} AS p", f"round((1 - {_P}) * 0.7E0, 6) AS p2", "CASE WHEN quality = 1 AND toxic = 0 THEN 'EQUIVALENT' WHEN quality = 1 THEN 'CONFLICT' ELSE 'DISTINCT' END AS best")
    others = F.array_except(F.array(*[F.lit(r) for r in de.RELATIONS]), F.array("best"))
    probs = F.map_from_arrays(F.array(F.col("best"), others[0], others[1]), F.array(F.col("p"), F.col("p2"), 1 - F.col("p") - F.col("p2")))
    return rows.select(de.takeover(probs).alias("t")).groupBy("t.reason").agg(F.count("*").alias("n"))


@query("shadow_agreement", f"WITH {_CHOICE} SELECT agrees, count(*) AS n FROM (SELECT best = CASE WHEN doc_id % 4 = 0 THEN 'DISTINCT' ELSE best END AS agrees FROM s) GROUP BY agrees")
def shadow(spark, sf):
    rows = table(spark, sf, "labels").selectExpr("CAST(doc_id AS STRING) AS id_a", "concat('x', CAST(doc_id AS STRING)) AS id_b", "CASE WHEN quality = 1 AND toxic = 0 THEN 'EQUIVALENT' WHEN quality = 1 THEN 'CONFLICT' ELSE 'DISTINCT' END AS relation", "doc_id")
    seen = de.observations(rows.withColumn("shadow_relation", F.when(F.col("doc_id") % 4 == 0, "DISTINCT").otherwise(F.col("relation"))), "salt")
    return seen.groupBy("agrees").agg(F.count("*").alias("n"))


_ERRORS = [(1, "Connection reset by peer", True), (5, "peer gone", False), (2, "HTTP 429 too many requests", True), (3, "invalid argument", False), (4, "Deadline exceeded", True)]


@query("transient_errors", f"WITH {literal_cte('e', 'k, message, transient', _ERRORS)} SELECT CAST(k AS BIGINT) AS k, transient FROM e UNION ALL SELECT 1000 + doc_id, regexp_matches(lower(text), '{'|'.join(tx.TRANSIENT_ERRORS)}') FROM documents")
def transient_errors(spark, sf):
    """The messages above, with the answers as they should be, and all documents."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("k"), F.col("text").alias("message"))
    rows = spark.createDataFrame(_ERRORS, "k bigint, message string, transient boolean").select("k", "message").union(docs)
    return rows.select("k", de.transient_error(F.col("message")).alias("transient"))


_JUDGED = [(1, "The port is 6333", "It uses port 6333", False, True), (2, "Paris", "I think Paris, France", False, True), (3, "a red bicycle", "a blue car", False, False), (4, "nothing", "I don't know", True, True), (5, "Paris", "I don't know", False, False), (6, "nothing", "Berlin", True, False), (7, "UK", "the uk", False, True)]


@query("rule_judge", f"WITH {literal_cte('j', 'k, gold, answer, abstain, correct', _JUDGED)} SELECT k, correct FROM j")
def judge(spark, sf):
    rows = spark.createDataFrame(_JUDGED, "k int, gold string, answer string, abstain boolean, correct boolean")
    return rows.select("k", de.rule_judge(F.col("gold"), F.col("answer"), F.col("abstain")).alias("correct"))


_TRAPS = [(1, "No information available.", "blue", True, True), (2, "It was blue, I don't know why", "blue", False, False), (3, "That never occurred", None, True, False), (4, "On Monday", "Sunday", False, False)]


@query("adversarial_answers", f"WITH {literal_cte('t', 'k, answer, trap, refused, strict', _TRAPS)} SELECT k, refused, strict FROM t")
def adversarial(spark, sf):
    rows = spark.createDataFrame(_TRAPS, "k int, answer string, trap string, refused boolean, strict boolean")
    return rows.select("k", de.adversarial(F.col("answer"), F.col("trap")).alias("refused"), de.adversarial(F.col("answer"), F.col("trap"), strict=True).alias("strict"))


_PROFILE_REPORTS = [("b", 0.5), ("a", 0.7), ("b", 0.5), ("c", 0.5)]


@query("profile_merge", "WITH p(name, ndcg) AS (VALUES ('a', 0.7::DOUBLE), ('b', 0.5::DOUBLE), ('c', 0.5::DOUBLE)) SELECT name, ndcg FROM p")
def profiles(spark, sf):
    return rc.merge_profiles(spark.createDataFrame(_PROFILE_REPORTS, "name string, ndcg double"))


@query("scale_curve", "WITH p(corpus_size, recall) AS (VALUES (100, 0.9::DOUBLE), (1000, 0.8::DOUBLE)) SELECT corpus_size, recall FROM p")
def curve(spark, sf):
    return rc.scale_curve(spark.createDataFrame([(1000, 0.8), (100, 0.9)], "corpus_size int, recall double"))
