"""Retrieval evaluation and classifier calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import calibration as cal
from memlake.operators import evaluation as ev
from memlake.operators import filters, search
from memlake.plans.q_search import _PROXY, asked
from memlake.plans.registry import query
from memlake.plans.views import columns_of, cte, literal_cte, table, view

_SECRET = tx.SECRET_RULES[0][0].replace("'", "''")
_CATEGORY = "CASE query_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'scope' WHEN 2 THEN 'temporal' ELSE 'hard_negative' END"
_EMPTY = "query_id % 8 = 3"
_GRADE = "CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END"


def _inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, the ranked candidates, relevance by a document's number, forbidden by toxicity."""
    queries = asked(spark, sf).selectExpr("query_id", f"{_CATEGORY} AS category", f"{_EMPTY} AS expected_empty")
    found = search.proxy_candidates(asked(spark, sf), view(spark, sf, "mem"), 20).select("query_id", F.col("id").cast("bigint").alias("doc_id"), F.col("rank").alias("pos")).where(~F.expr(_EMPTY) | (F.col("query_id") % 16 == 11))
    qrels = found.where((F.col("pos") % 4 <= 1) & ~F.expr(_EMPTY)).selectExpr("query_id", "doc_id", f"{_GRADE} AS grade")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return queries, found, qrels, found.join(toxic, "doc_id", "left_semi").select("query_id", "doc_id")


_CELLS = f"""WITH {_PROXY}, qs AS (SELECT query_id, {_CATEGORY} AS category, {_EMPTY} AS expected_empty FROM asked),
f AS (SELECT query_id, CAST(id AS BIGINT) AS doc_id, rank AS pos FROM cand WHERE NOT ({_EMPTY}) OR query_id % 16 = 11),
qr AS (SELECT query_id, doc_id, {_GRADE} AS grade FROM f WHERE pos % 4 <= 1 AND NOT ({_EMPTY})),
fb AS (SELECT query_id, doc_id FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
h AS (SELECT f.query_id, f.pos, qr.grade, fb.doc_id IS NOT NULL AS bad FROM f LEFT JOIN qr ON qr.query_id = f.query_id AND qr.doc_id = f.doc_id AND qr.grade > 0 LEFT JOIN fb ON fb.query_id = f.query_id AND fb.doc_id = f.doc_id),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
g AS (SELECT query_id, k, count(*) FILTER (WHERE pos <= k AND grade IS NOT NULL) AS h, count(*) FILTER (WHERE pos <= k) AS n, sum((pow(2, grade) - 1) / log2(pos + 1)) FILTER (WHERE pos <= k AND grade IS NOT NULL) AS d, count(*) FILTER (WHERE pos <= k AND bad) AS b FROM h, ks GROUP BY 1, 2),
id AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qr WHERE grade > 0),
iw AS (SELECT query_id, k, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= k) AS i FROM id, ks GROUP BY 1, 2),
a AS (SELECT qs.*, ks.k, coalesce(h, 0) AS h, coalesce(n, 0) AS n, coalesce(d, 0) AS d, coalesce(b, 0) AS b, coalesce(relevant, 0) AS relevant, i FROM qs CROSS JOIN ks LEFT JOIN g USING (query_id, k) LEFT JOIN iw USING (query_id, k)),
cells AS (SELECT query_id, category, expected_empty, concat('hit_rate@', k) AS metric, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM a
 UNION ALL SELECT query_id, category, expected_empty, concat('precision@', k), h / k FROM a
 UNION ALL SELECT query_id, category, expected_empty, concat('recall@', k), CASE WHEN relevant = 0 THEN CASE WHEN expected_empty AND n = 0 THEN 1.0 ELSE 0.0 END ELSE h / relevant END FROM a
 UNION ALL SELECT query_id, category, expected_empty, concat('ndcg@', k), CASE WHEN relevant = 0 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, d / i) END FROM a
 UNION ALL SELECT query_id, category, expected_empty, concat('forbidden_leakage@', k), b FROM a
 UNION ALL SELECT query_id, category, expected_empty, concat('empty_accuracy@', k), CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END FROM a WHERE expected_empty
 UNION ALL SELECT qs.query_id, category, expected_empty, 'mrr', coalesce(1.0::DOUBLE / (SELECT min(pos) FROM h WHERE h.query_id = qs.query_id AND grade IS NOT NULL), 0) FROM qs)"""
_SKIP = "NOT (expected_empty AND (" + " OR ".join(f"starts_with(metric, '{p}')" for p in ev.EXCLUDED) + "))"


@query("ir_metrics_per_query", f"{_CELLS} SELECT query_id, metric, round(value, 6) AS value FROM cells")
def ir_per_query(spark, sf):
    return ev.per_query(*_inputs(spark, sf)).select("query_id", "metric", F.round("value", 6).alias("value"))


@query("ir_metrics_overall", f"{_CELLS} SELECT metric, round(avg(value), 4) AS value FROM cells WHERE {_SKIP} GROUP BY metric")
def ir_overall(spark, sf):
    return ev.means(ev.per_query(*_inputs(spark, sf)))


@query("report_markdown", f"{_CELLS}, m AS (SELECT metric, round(avg(value), 4) AS value FROM cells WHERE {_SKIP} GROUP BY metric) SELECT n, line FROM (VALUES (1, '# Retrieval'), (2, ''), (3, '| metric | value |'), (4, '|---|---|')) AS h(n, line) UNION ALL SELECT CAST(4 + row_number() OVER (ORDER BY metric) AS INT), concat('| ', metric, ' | ', printf('%.4f', value), ' |') FROM m")
def report_markdown(spark, sf):
    return ev.report_lines(ev.means(ev.per_query(*_inputs(spark, sf))), "Retrieval")


@query("ir_metrics_by_category", f"{_CELLS} SELECT category, metric, round(avg(value), 4) AS value FROM cells WHERE {_SKIP} GROUP BY ALL")
def ir_by_category(spark, sf):
    return ev.means(ev.per_query(*_inputs(spark, sf)), "category")


@query("report_query_diff", f"{_CELLS}, x AS (SELECT query_id, value AS base, CASE WHEN query_id % 5 = 0 THEN greatest(0, value - 0.2) WHEN query_id % 5 = 1 THEN least(1, value + 0.2) ELSE value END AS new FROM cells WHERE metric = 'recall@3') SELECT query_id, round(new - base, 4) AS delta, CASE WHEN new < base THEN 'regressed' ELSE 'improved' END AS change FROM x WHERE new <> base")
def query_diff(spark, sf):
    base = ev.per_query(*_inputs(spark, sf)).where("metric = 'recall@3'").select("query_id", F.col("value").alias("base"))
    new = base.selectExpr("query_id", "CASE WHEN query_id % 5 = 0 THEN greatest(0D, base - 0.2D) WHEN query_id % 5 = 1 THEN least(1D, base + 0.2D) ELSE base END AS new")
    both = base.join(new, "query_id").where("new <> base")
    return both.select("query_id", F.round(F.col("new") - F.col("base"), 4).alias("delta"), F.when(F.col("new") < F.col("base"), "regressed").otherwise("improved").alias("change"))


@query("report_metric_diff", f"{_CELLS}, m AS (SELECT metric, query_id % 2 AS half, round(avg(value), 4) AS value FROM cells WHERE {_SKIP} AND NOT (metric = 'mrr' AND query_id % 2 = 1) GROUP BY 1, 2), d AS (SELECT coalesce(b.metric, n.metric) AS metric, coalesce(b.value, 0) AS base, coalesce(n.value, 0) AS new FROM (SELECT * FROM m WHERE half = 0) b FULL JOIN (SELECT * FROM m WHERE half = 1) n ON b.metric = n.metric) SELECT metric, base, new, round(new - base, 4) AS delta, CASE WHEN metric IN ('recall@3', 'ndcg@3', 'mrr') AND round(new - base, 4) < -0.02 THEN 'regressed' WHEN starts_with(metric, 'forbidden_leakage') AND new > 0 THEN 'leak' ELSE 'ok' END AS status FROM d")
def metric_diff(spark, sf):
    cells = ev.per_query(*_inputs(spark, sf)).where("not (metric = 'mrr' and query_id % 2 = 1)").withColumn("half", F.col("query_id") % 2)
    runs = ev.means(cells, "half")
    return ev.metric_diff(runs.where("half = 0").drop("half"), runs.where("half = 1").drop("half"))


@query("candidate_recall20", f"{_CELLS} SELECT qr.query_id, round(count(*) FILTER (WHERE pos <= 20) / count(*), 6) AS recall FROM qr JOIN f USING (query_id, doc_id) WHERE grade > 0 GROUP BY qr.query_id")
def candidate_recall(spark, sf):
    _, found, qrels, _ = _inputs(spark, sf)
    j = qrels.where("grade > 0").join(found, ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg(F.round(F.count_if(F.col("pos") <= 20) / F.count("*"), 6).alias("recall"))


@query("injected_tokens", f"{_CELLS} SELECT round(sum(greatest(1, length(memory) // 4)) / count(DISTINCT query_id), 4) AS avg_tokens, CAST(sum(length(memory)) AS BIGINT) AS chars FROM f JOIN mem USING (doc_id) WHERE pos <= 3")
def injected_tokens(spark, sf):
    _, found, _, _ = _inputs(spark, sf)
    text = found.where("pos <= 3").join(view(spark, sf, "mem").select("doc_id", F.length("memory").alias("n")), "doc_id")
    return text.agg(F.round(F.sum(F.greatest(F.lit(1), F.floor(F.col("n") / 4))) / F.count_distinct("query_id"), 4).alias("avg_tokens"), F.sum("n").cast("bigint").alias("chars"))


@query("token_cost", "SELECT source, CAST(sum(greatest(1, ceil(length(text) / 4.0))) AS BIGINT) AS tokens, round(sum(greatest(1, ceil(length(text) / 4.0))) * 0.00000015::DOUBLE, 8) AS cost FROM documents GROUP BY source")
def token_cost(spark, sf):
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 4))
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(n).cast("bigint").alias("tokens"), F.round(F.sum(n) * 0.00000015, 8).alias("cost"))


@query("latency_pctl_runner", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (WHERE r = floor(n * 0.5) + 1) AS p50, max(value) FILTER (WHERE r = least(n - 1, floor(n * 0.95)) + 1) AS p95 FROM r GROUP BY event_type")
def pctl_runner(spark, sf):
    return ev.runner_percentiles(table(spark, sf, "events"), "event_type", "value")


@query("latency_pctl_nearest", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def pctl_nearest(spark, sf):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(p * 100)}")
    return table(spark, sf, "events").groupBy("event_type").agg(at(0.5), at(0.95), at(0.99))


@query("latency_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("breach_streak", "WITH r AS (SELECT event_type AS metric, CAST(event_id AS BIGINT) AS run, event_id % 7 > 1 AS breached FROM events), o AS (SELECT metric, max(run) FILTER (WHERE NOT breached) AS ok FROM r GROUP BY metric) SELECT metric, count(*) FILTER (WHERE ok IS NULL OR run > ok) AS streak FROM r JOIN o USING (metric) GROUP BY metric")
def breach(spark, sf):
    return ev.breach_streak(table(spark, sf, "events").selectExpr("event_type AS metric", "event_id AS run", "event_id % 7 > 1 AS breached"))


@query("security_audit", f"WITH {_PROXY}, j AS (SELECT cand.query_id, mem.user_id, mem.agent_id, mem.scope, mem.status, {_EMPTY.replace('query_id', 'cand.query_id')} AS expected_empty FROM cand JOIN mem USING (id) WHERE rank <= 5) SELECT count(*) FILTER (WHERE user_id <> 'u2') AS cross_user, count(*) FILTER (WHERE user_id = 'u2' AND scope = 'project' AND agent_id <> 'p1') AS cross_project, count(*) FILTER (WHERE status = 'superseded') AS superseded, round(count(DISTINCT query_id) FILTER (WHERE expected_empty) / (SELECT count(*) FROM asked WHERE {_EMPTY}), 4) AS false_positive_rate FROM j")
def security(spark, sf):
    # the ungated pool stands for a run without isolation
    found = search.proxy_candidates(asked(spark, sf), view(spark, sf, "mem"), 20).where("rank <= 5").join(view(spark, sf, "mem").select("id", "user_id", "agent_id", "scope", "status"), "id")
    empties = asked(spark, sf).where(_EMPTY).count()
    mine = F.col("user_id") == "u2"
    out = found.agg(F.count_if(~mine).alias("cross_user"), F.count_if(mine & (F.col("scope") == "project") & (F.col("agent_id") != "p1")).alias("cross_project"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.count_distinct(F.when(F.expr(_EMPTY), F.col("query_id"))).alias("fp"))
    return out.select("cross_user", "cross_project", "superseded", F.round(F.try_divide(F.col("fp"), F.lit(empties)), 4).alias("false_positive_rate"))


@query("dataset_integrity", f"WITH {cte('mem')}, v AS (SELECT 'duplicate_text' AS violation, count(*) AS n FROM (SELECT memory FROM mem GROUP BY memory HAVING count(*) > 1) UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'empty_text', count(*) FROM mem WHERE trim(memory) = '' UNION ALL SELECT 'toxic_but_good', count(*) FROM labels WHERE toxic = 1 AND quality = 1 UNION ALL SELECT 'secret_in_text', count(*) FROM mem WHERE regexp_matches(memory, '{_SECRET}')) SELECT violation, n FROM v WHERE n > 0")
def integrity(spark, sf):
    mem, labels = view(spark, sf, "mem"), table(spark, sf, "labels")
    name = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("violation"), "n")
    # equal texts meet by their hash, so that whole texts aren't shuffled
    every = name(mem.groupBy(F.sha2("memory", 256)).count().where("count > 1"), "duplicate_text")
    every = every.union(name(labels.join(mem.select("doc_id"), "doc_id", "left_anti"), "label_without_document"))
    one_pass = mem.agg(F.count_if(F.trim("memory") == "").alias("empty_text"), F.count_if(F.col("memory").rlike(tx.SECRET_RULES[0][0])).alias("secret_in_text"))
    every = every.union(one_pass.select(F.explode(F.create_map(F.lit("empty_text"), F.col("empty_text"), F.lit("secret_in_text"), F.col("secret_in_text"))).alias("violation", "n")))
    return every.union(name(labels.where("toxic = 1 and quality = 1"), "toxic_but_good")).where("n > 0")


# --- calibration: labels as gold relations, a document's number as the classifier ---

_GOLD = "CASE WHEN quality = 1 AND toxic = 0 THEN 'EQUIVALENT' WHEN quality = 1 THEN 'CONFLICT' ELSE 'DISTINCT' END"
_P = "round(0.34E0 + (doc_id * 37 % 660) / 1000.0E0, 4)"
_PREDICTED = f"CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'CONFLICT' ELSE {_GOLD} END"
_SAMPLES = f"s AS (SELECT doc_id, {_GOLD} AS gold, {_PREDICTED} AS predicted, {_P} AS p, round((1 - {_P}) * 0.7E0, 6) AS p2 FROM labels)"


def samples(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id", f"{_GOLD} AS gold", f"{_PREDICTED} AS predicted", f"{_P} AS p", f"round((1 - {_P}) * 0.7E0, 6) AS p2")


@query("confusion_metrics", f"WITH {_SAMPLES}, c AS (SELECT unnest(['EQUIVALENT', 'CONFLICT', 'DISTINCT']) AS relation), x AS (SELECT relation, count(*) FILTER (WHERE gold = relation AND predicted = relation) AS tp, count(*) FILTER (WHERE gold <> relation AND predicted = relation) AS fp, count(*) FILTER (WHERE gold = relation AND (predicted IS NULL OR predicted <> relation)) AS fn, count(*) FILTER (WHERE gold = relation) AS support FROM s, c GROUP BY relation) SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(support, 0), 4) AS recall FROM x")
def confusion(spark, sf):
    return cal.confusion(samples(spark, sf))


@query("prob_buckets", f"WITH {_SAMPLES} SELECT CASE WHEN p <= 0.5 THEN '[0,0.5]' WHEN p <= 0.7 THEN '(0.5,0.7]' WHEN p <= 0.9 THEN '(0.7,0.9]' ELSE '(0.9,1]' END AS bucket, count(*) AS n, count(*) FILTER (WHERE predicted = gold) AS correct, round(count(*) FILTER (WHERE predicted = gold) / count(*), 4) AS accuracy FROM s WHERE predicted IS NOT NULL GROUP BY 1")
def prob_buckets(spark, sf):
    right = F.count_if(F.col("predicted") == F.col("gold"))
    return samples(spark, sf).where("predicted is not null").groupBy(cal.bucket(F.col("p")).alias("bucket")).agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 4).alias("accuracy"))


@query("abstention", f"WITH {_SAMPLES} SELECT round(count(*) FILTER (WHERE predicted IS NULL) / count(*), 4) AS abstention_rate, count(*) FILTER (WHERE predicted = 'EQUIVALENT' AND gold <> 'EQUIVALENT') AS false_merge, count(*) FILTER (WHERE predicted = 'CONFLICT' AND gold <> 'CONFLICT') AS false_supersede, count(*) FILTER (WHERE predicted IS NOT NULL AND doc_id % 20 = 1) AS must_abstain_violations FROM s")
def abstention(spark, sf):
    p, g = F.col("predicted"), F.col("gold")
    return samples(spark, sf).agg(F.round(F.count_if(p.isNull()) / F.count("*"), 4).alias("abstention_rate"), F.count_if((p == "EQUIVALENT") & (g != p)).alias("false_merge"), F.count_if((p == "CONFLICT") & (g != p)).alias("false_supersede"), F.count_if(p.isNotNull() & (F.col("doc_id") % 20 == 1)).alias("must_abstain_violations"))


@query("brier_score", f"WITH {_SAMPLES}, b AS (SELECT predicted, (SELECT sum(pow(CASE WHEN c = predicted THEN p WHEN c = CASE WHEN predicted = 'DISTINCT' THEN 'EQUIVALENT' ELSE 'DISTINCT' END THEN p2 ELSE 0 END - CASE WHEN c = gold THEN 1 ELSE 0 END, 2)) FROM (SELECT unnest(['EQUIVALENT', 'CONFLICT', 'DISTINCT']) AS c)) AS b FROM s WHERE predicted IS NOT NULL) SELECT predicted, round(avg(b), 6) AS brier, round(least(1, -ln(0.05) / count(*)), 4) AS error_bound FROM b GROUP BY predicted")
def brier(spark, sf):
    other = F.when(F.col("predicted") == "DISTINCT", "EQUIVALENT").otherwise("DISTINCT")
    rows = samples(spark, sf).where("predicted is not null").withColumn("probs", F.map_from_arrays(F.array("predicted", other), F.array("p", "p2")))
    return rows.groupBy("predicted").agg(F.round(F.avg(cal.brier(F.col("probs"), F.col("gold"))), 6).alias("brier"), cal.error_bound(F.count("*")).alias("error_bound"))


_PS, _MS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), (0.0, 0.2, 0.4, 0.6, 0.8)
_UNSAFE = "predicted IS NOT NULL AND predicted <> gold AND p < 0.83"


@query("threshold_grid", f"WITH {_SAMPLES}, r AS (SELECT p, round(p - p2, 6) AS margin, {_UNSAFE} AS unsafe FROM s), g AS (SELECT min_p, min_margin FROM (SELECT unnest({list(_PS)})::DOUBLE AS min_p), (SELECT unnest({list(_MS)})::DOUBLE AS min_margin)), x AS (SELECT min_p, min_margin, count(*) FILTER (WHERE p >= min_p AND margin >= min_margin) AS accepted, count(*) FILTER (WHERE p >= min_p AND margin >= min_margin AND unsafe) AS unsafe FROM r, g GROUP BY 1, 2) SELECT min_p, min_margin, accepted, unsafe FROM x WHERE unsafe = 0 ORDER BY accepted DESC, min_p, min_margin LIMIT 1")
def grid(spark, sf):
    rows = samples(spark, sf).select("p", F.round(F.col("p") - F.col("p2"), 6).alias("margin"), F.expr(_UNSAFE).alias("unsafe"))
    return cal.threshold_grid(rows, _PS, _MS)


_BEHIND = f"""SELECT doc_id, {_GOLD} AS gold, doc_id % 20 = 1 AS must_abstain, {_PREDICTED} AS prediction, {_P} AS probability, round({_P} - (1 - {_P}) * 0.7E0, 6) AS margin, round((1 - {_P}) * 0.7E0, 6) AS p2,
 CASE WHEN doc_id % 9 <> 0 THEN 100 + doc_id % 350 END AS latency_ms, doc_id % 500 AS input_tokens, doc_id % 40 AS output_tokens, (doc_id % 70) * 0.0001E0 AS cost_usd, CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'mixed' END AS language FROM labels"""
_OTHER = "CASE WHEN prediction = 'DISTINCT' THEN 'EQUIVALENT' ELSE 'DISTINCT' END"


@query("thresholded_metrics", f"""WITH r AS ({_BEHIND}), x AS (SELECT *, CASE WHEN margin <= 0 THEN NULL WHEN prediction = 'EQUIVALENT' THEN CASE WHEN probability >= 0.8 AND margin >= 0.25 THEN prediction END WHEN prediction = 'CONFLICT' THEN CASE WHEN probability >= 0.75 AND margin >= 0.2 THEN prediction END ELSE prediction END AS said,
 CASE WHEN prediction IS NOT NULL THEN (SELECT sum(pow(CASE WHEN c = prediction THEN probability WHEN c = {_OTHER} THEN p2 ELSE 0 END - CASE WHEN c = gold THEN 1 ELSE 0 END, 2)) FROM (SELECT unnest(['EQUIVALENT', 'CONFLICT', 'DISTINCT']) AS c)) END AS b FROM r),
a AS (SELECT language, count(*) AS n, count(*) FILTER (WHERE NOT must_abstain) AS eligible, count(said) FILTER (WHERE NOT must_abstain) AS accepted, count(*) FILTER (WHERE NOT must_abstain AND said <> 'DISTINCT') AS destructive, count(*) FILTER (WHERE must_abstain OR said IS NULL) AS abstentions,
 count(*) FILTER (WHERE NOT must_abstain AND said = 'EQUIVALENT' AND gold <> said) AS false_merge, count(*) FILTER (WHERE NOT must_abstain AND said = 'CONFLICT' AND gold <> said) AS false_supersede, count(said) FILTER (WHERE must_abstain) AS must_abstain_violations,
 count(*) FILTER (WHERE NOT must_abstain AND gold = 'EQUIVALENT') AS ge, count(*) FILTER (WHERE NOT must_abstain AND gold = 'CONFLICT') AS gc, count(*) FILTER (WHERE NOT must_abstain AND gold = said AND gold = 'EQUIVALENT') AS he, count(*) FILTER (WHERE NOT must_abstain AND gold = said AND gold = 'CONFLICT') AS hc,
 round(avg(b) FILTER (WHERE NOT must_abstain), 6) AS brier, quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM x GROUP BY language)
SELECT language, n, eligible, accepted, destructive, abstentions, false_merge, false_supersede, must_abstain_violations, coalesce(round(destructive / nullif(ge + gc, 0), 4), 0) AS destructive_coverage, round(he / nullif(ge, 0), 4) AS recall_equivalent, round(hc / nullif(gc, 0), 4) AS recall_conflict,
 brier, latency_p50, latency_p95, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, cost_usd, coalesce(round(accepted / nullif(eligible, 0), 4), 0) AS coverage, coalesce(round(abstentions / nullif(n, 0), 4), 0) AS abstention_rate,
 CASE WHEN false_merge + false_supersede = 0 AND destructive > 0 THEN round(least(1, -ln(0.05) / destructive), 4) END AS error_bound FROM a""")
def thresholded_metrics(spark, sf):
    rows = table(spark, sf, "labels").selectExpr(*columns_of(_BEHIND))
    probabilities = F.when(F.col("prediction").isNotNull(), F.map_from_arrays(F.array("prediction", F.expr(_OTHER)), F.array("probability", "p2")))
    return cal.thresholded(rows.withColumn("probabilities", probabilities), ["language"])


@query("ingest_budget", "WITH b AS (SELECT count(*) AS items, CAST(coalesce(sum((length(text) + 3) // 4), 0) AS BIGINT) AS tokens FROM documents) SELECT items, tokens, round(tokens / 1000000 * 0.15::DOUBLE, 6) AS cost, CASE WHEN items > 1000000 THEN 'too_many_items' WHEN tokens / 1000000 * 0.15::DOUBLE > 0.01 THEN 'too_costly' ELSE 'ok' END AS verdict FROM b")
def ingest_budget(spark, sf):
    return filters.ingest_budget(table(spark, sf, "documents"), 1_000_000, 0.01, 0.15, F.floor((F.length("text") + 3) / 4))


# --- answers -------------------------------------------------------------------

_ANSWERS = [(1, "the cat and a dog", "a dog, the cat"), (2, "Paris", "paris."), (3, "7 May 2023", "May 7, 2023"), (4, "blue", "red"), (5, "unknown", "I don't know"), (6, "to be or not to be", "be be to"), (7, "An apple", "apple"), (8, "x y z", "x y"), (9, "not mentioned", "It is not mentioned in the text")]
_NORM = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(replace({0}, ',', '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the|and)\\b', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_F1 = f"""WITH {literal_cte('a', 'id, gold, answer', _ANSWERS)}, n AS (SELECT id, {_NORM.format('gold')} AS g, {_NORM.format('answer')} AS p, lower(answer) AS low FROM a),
gc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(g) AS w FROM n) GROUP BY 1, 2), pc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(p) AS w FROM n) GROUP BY 1, 2),
s AS (SELECT id, sum(least(gc.c, pc.c)) AS shared FROM gc JOIN pc USING (id, w) GROUP BY id)"""


@query("token_f1", f"{_F1} SELECT n.id, round(CASE WHEN shared IS NULL THEN 0 ELSE 2 * (shared / len(p)) * (shared / len(g)) / (shared / len(p) + shared / len(g)) END, 6) AS f1, list_sort(list_distinct(g)) = list_sort(list_distinct(p)) AS exact FROM n LEFT JOIN s USING (id)")
def token_f1(spark, sf):
    rows = spark.createDataFrame(_ANSWERS, "id int, gold string, answer string").select("id", tx.answer_words(F.col("gold")).alias("g"), tx.answer_words(F.col("answer")).alias("p"))
    count = lambda c: rows.select("id", F.explode(c).alias("w")).groupBy("id", "w").agg(F.count("*").alias(f"n_{c}"))
    shared = count("g").join(count("p"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("n_g", "n_p")).alias("x"))
    p, r = F.col("x") / F.size("p"), F.col("x") / F.size("g")
    same = F.array_sort(F.array_distinct("g")) == F.array_sort(F.array_distinct("p"))
    return rows.join(shared, "id", "left").select("id", F.round(F.coalesce(2 * p * r / (p + r), F.lit(0.0)), 6).alias("f1"), same.alias("exact"))


_SAID = f"{literal_cte('a0', 'id, gold, answer', _ANSWERS)}, a AS (SELECT CAST(id AS BIGINT) AS id, answer FROM a0 UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations)"


@query("abstention_phrases", f"WITH {_SAID} SELECT id, " + " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in tx.ABSTENTIONS) + " AS abstains FROM a")
def abstains(spark, sf):
    """The answers above and all turns."""
    turns = table(spark, sf, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"))
    rows = spark.createDataFrame(_ANSWERS, "id bigint, gold string, answer string").select("id", "answer").union(turns)
    return rows.select("id", tx.holds_any(F.col("answer"), tx.ABSTENTIONS).alias("abstains"))


_MULTI = [(1, "red, blue ", "blue,green"), (2, "new york, paris", "york,the paris"), (3, "one", "two")]


@query("multi_answer_f1", f"""WITH {literal_cte('m', 'id, golds, preds', _MULTI)}, g AS (SELECT id, gi, {_NORM.format('ga')} AS g FROM (SELECT id, unnest(range(1, len(string_split(golds, ',')) + 1)) AS gi, unnest(string_split(golds, ',')) AS ga FROM m)),
p AS (SELECT id, pi, {_NORM.format('pa')} AS p FROM (SELECT id, unnest(range(1, len(string_split(preds, ',')) + 1)) AS pi, unnest(string_split(preds, ',')) AS pa FROM m)),
x AS (SELECT id, gi, pi, g, p, (SELECT sum(least(len(list_filter(g, lambda y: y = w)), len(list_filter(p, lambda y: y = w)))) FROM (SELECT DISTINCT unnest(g) AS w)) AS s FROM g JOIN p USING (id)),
f AS (SELECT id, gi, max(CASE WHEN s > 0 THEN 2.0 * s / (len(g) + len(p)) ELSE 0 END) AS best FROM x GROUP BY 1, 2) SELECT id, round(avg(best), 6) AS f1 FROM f GROUP BY id""")
def multi_f1(spark, sf):
    rows = spark.createDataFrame(_MULTI, "id int, golds string, preds string")
    g = rows.select("id", F.posexplode(F.split("golds", ",")).alias("gi", "ga")).select("id", "gi", tx.answer_words(F.col("ga")).alias("g"))
    p = rows.select("id", F.explode(F.split("preds", ",")).alias("pa")).select("id", tx.answer_words(F.col("pa")).alias("p"))
    times = lambda words, w: F.size(F.filter(words, lambda y: y == w))
    shared = F.aggregate(F.array_distinct("g"), F.lit(0), lambda acc, w: acc + F.least(times(F.col("g"), w), times(F.col("p"), w)))
    f1 = F.try_divide(2.0 * shared, F.size("g") + F.size("p"))
    return g.join(p, "id").groupBy("id", "gi").agg(F.max(f1).alias("best")).groupBy("id").agg(F.round(F.avg("best"), 6).alias("f1"))


_LOSS = [("exact", 0.92, 0.85, 0.80), ("scope", 0.70, None, 0.75), ("temporal", 0.5, 0.61, 0.4), ("all", None, 0.5, None)]


@query("loss_quant", f"WITH {literal_cte('l', 'category, facts, retrieved, answered', _LOSS)} SELECT category, greatest(0, round(CAST(facts AS DOUBLE) - retrieved, 4)) + CASE WHEN facts IS NULL OR retrieved IS NULL THEN NULL ELSE 0 END AS retrieval_loss, greatest(0, round(CAST(retrieved AS DOUBLE) - answered, 4)) + CASE WHEN retrieved IS NULL OR answered IS NULL THEN NULL ELSE 0 END AS answer_loss FROM l")
def loss(spark, sf):
    rows = spark.createDataFrame(_LOSS, "category string, facts double, retrieved double, answered double")
    delta = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0.0), F.round(F.col(a) - F.col(b), 4)))
    return rows.select("category", delta("facts", "retrieved").alias("retrieval_loss"), delta("retrieved", "answered").alias("answer_loss"))
