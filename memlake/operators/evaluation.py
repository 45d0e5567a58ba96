"""Retrieval metrics, reports and their comparison, security and integrity audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KS = (1, 3, 5, 10)
#: Metrics that rows with an expected empty answer don't enter.
EXCLUDED = ("hit_rate@", "precision@", "recall@", "ndcg@", "mrr", "candidate_recall@")


def first_places(retrieved: DataFrame) -> DataFrame:
    """(query_id, doc_id, pos): first occurrences, ranked again from 1."""
    first = retrieved.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "doc_id")))


def per_query(queries: DataFrame, retrieved: DataFrame, qrels: DataFrame, forbidden: DataFrame, ks=KS) -> DataFrame:
    """(query_id, category, expected_empty, metric, value).

    queries: query_id, category, expected_empty; retrieved: query_id, doc_id, pos;
    qrels: query_id, doc_id, grade; forbidden: query_id, doc_id.
    """
    ranked = first_places(retrieved)
    hits = ranked.join(qrels.where("grade > 0"), ["query_id", "doc_id"], "left").join(forbidden.select("query_id", "doc_id", F.lit(1).alias("bad")), ["query_id", "doc_id"], "left")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("pos") + 1)
    good = F.col("grade").isNotNull()
    aggs = [F.min(F.when(good, F.col("pos"))).alias("first_hit")]
    for k in ks:
        near = F.col("pos") <= k
        aggs += [F.count_if(near & good).alias(f"h{k}"), F.count_if(near).alias(f"n{k}"), F.sum(F.when(near & good, gain)).alias(f"d{k}"), F.count_if(near & F.col("bad").isNotNull()).alias(f"b{k}")]
    got = hits.groupBy("query_id").agg(*aggs)
    ideal = qrels.where("grade > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    best = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1)
    wanted = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("r") <= k, best)).alias(f"i{k}") for k in ks])
    rows = queries.join(got, "query_id", "left").join(wanted, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    empty = F.col("expected_empty")
    pairs: list[tuple[str, Column]] = [("mrr", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)))]
    for k in ks:
        blank = empty & (zero(f"n{k}") == 0)
        none = zero("relevant") == 0
        pairs += [
            (f"hit_rate@{k}", (zero(f"h{k}") > 0).cast("double")), (f"precision@{k}", zero(f"h{k}") / k),
            (f"recall@{k}", F.when(none, blank.cast("double")).otherwise(F.try_divide(zero(f"h{k}"), F.col("relevant")))),
            (f"ndcg@{k}", F.when(none, (zero(f"n{k}") == 0).cast("double")).otherwise(F.least(F.lit(1.0), F.try_divide(F.coalesce(F.col(f"d{k}"), F.lit(0.0)), F.col(f"i{k}"))))),
            (f"forbidden_leakage@{k}", zero(f"b{k}").cast("double")), (f"empty_accuracy@{k}", F.when(empty, blank.cast("double"))),
        ]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in pairs])
    return rows.select("query_id", "category", "expected_empty", F.explode(cells).alias("c")).select("query_id", "category", "expected_empty", "c.metric", "c.value").where("value is not null")


def means(cells: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric, in groups; rows with an expected empty answer count only where they say something."""
    skip = F.lit(False)
    for prefix in EXCLUDED:
        skip = skip | F.col("metric").startswith(prefix)
    return cells.where(~(skip & F.col("expected_empty"))).groupBy(*by, "metric").agg(F.round(F.avg("value"), 4).alias("value"))


def percentile_at(c: Column, index: Column) -> Column:
    return F.element_at(F.sort_array(F.collect_list(c)), index)


def runner_percentiles(values: DataFrame, by: str, column: str) -> DataFrame:
    """Of each group the value at place n * p of the sorted values, at p 0.5 and 0.95, by a window instead of a list."""
    w = Window.partitionBy(by)
    ranked = values.where(F.col(column).isNotNull()).select(by, column, F.row_number().over(w.orderBy(column)).alias("r"), F.count("*").over(w).alias("n"))
    at50, at95 = F.floor(F.col("n") * 0.5), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return ranked.groupBy(by).agg(F.max(F.when(F.col("r") == at50 + 1, F.col(column))).alias("p50"), F.max(F.when(F.col("r") == at95 + 1, F.col(column))).alias("p95"))


def metric_diff(base: DataFrame, new: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, base, new, delta, status): full outer, a missing metric counts as 0."""
    joined = base.withColumnRenamed("value", "base").join(new.withColumnRenamed("value", "new"), "metric", "full_outer").fillna(0.0, ["base", "new"])
    delta = F.round(F.col("new") - F.col("base"), 4)
    status = F.when(F.col("metric").isin("recall@3", "ndcg@3", "mrr") & (delta < -tolerance), "regressed").when(F.col("metric").startswith("forbidden_leakage") & (F.col("new") > 0), "leak").otherwise("ok")
    return joined.select("metric", "base", "new", delta.alias("delta"), status.alias("status"))


def breach_streak(runs: DataFrame) -> DataFrame:
    """Of each metric the number of breaches in a row at the end: (metric, run, breached) -> (metric, streak)."""
    last_ok = F.max(F.when(~F.col("breached"), F.col("run")))
    by = runs.groupBy("metric").agg(last_ok.alias("ok"))
    return runs.join(by, "metric").groupBy("metric").agg(F.count_if(F.col("ok").isNull() | (F.col("run") > F.col("ok"))).alias("streak"))


def report_lines(metrics: DataFrame, title: str) -> DataFrame:
    """(n, line): metrics (metric, value) as a Markdown table, by name; a missing value is a dash."""
    rows = metrics.select(F.row_number().over(Window.orderBy("metric")).alias("k"), F.concat(F.lit("| "), "metric", F.lit(" | "), F.coalesce(F.format_string("%.4f", F.col("value").cast("double")), F.lit("-")), F.lit(" |")).alias("line"))
    head = metrics.sparkSession.createDataFrame([(1, f"# {title}"), (2, ""), (3, "| metric | value |"), (4, "|---|---|")], "n int, line string")
    return head.union(rows.select((F.col("k") + 4).cast("int"), "line"))
