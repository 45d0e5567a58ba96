"""Search as a call: scope and filters, candidates, lifecycle, gate, and what happened at each stage; temporal questions go to the timeline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import filters, search, timeline


def _decided(queries: DataFrame, memories: DataFrame, user: str, scope: str, project: str | None, limit: int, custom: Mapping | None, threshold: float | None, config: search.GateConfig | None) -> DataFrame:
    """Every candidate with its scores and the gate's reason: one plan for search and trace, so that a trace can't change what is found."""
    spec = filters.compose(filters.scope_filter(scope, user, project), custom)
    visible = memories.where(filters.compile_filter(spec) & filters.active())
    # a threshold of 0 is a threshold
    found = search.fuse(search.pooled(queries, visible, search.pool_size(limit), search.THRESHOLD if threshold is None else threshold))
    met = search.memory_features(visible.join(found.select("id").distinct(), "id", "left_semi").select("id", "memory", "user_id", "agent_id", "scope", "status"))
    rows = found.join(met, "id").join(queries.select("query_id", "query"), "query_id")
    return search.gate(rows.withColumn("score", F.col("final_score")).withColumn("has_details", F.lit(True)), limit, config)


def find(queries: DataFrame, memories: DataFrame, user: str, scope: str = "all", project: str | None = None, limit: int = 5, custom: Mapping | None = None, threshold: float | None = None, config: search.GateConfig | None = None) -> DataFrame:
    """(query_id, id, memory, final_score, rank) of what each query recalls, at most limit; a limit of 0 or less recalls nothing.

    queries: query_id, query, embedding; memories: id, memory, embedding,
    entity_boost, user_id, agent_id, scope, status and the columns of custom filters,
    which can only narrow the scope.
    """
    rows = _decided(queries, memories, user, scope, project, max(limit, 1), custom, threshold, config)
    return rows.where("accepted" if limit > 0 else "false").select("query_id", "id", "memory", "final_score", "rank")


def trace(queries: DataFrame, memories: DataFrame, user: str, scope: str = "all", project: str | None = None, limit: int = 5, custom: Mapping | None = None, threshold: float | None = None, config: search.GateConfig | None = None) -> DataFrame:
    """(query_id, stage, id, passed, reason, score) of the same search: a row for each candidate at every stage it reached."""
    rows = _decided(queries, memories, user, scope, project, max(limit, 1), custom, threshold, config).where("true" if limit > 0 else "false")
    live = filters.active()
    stage = lambda name, passed, reason: F.struct(F.lit(name).alias("stage"), passed.alias("passed"), reason.alias("reason"))
    steps = F.array(
        stage("candidate", F.lit(True), F.lit("retrieved")), stage("lifecycle_scope", live, F.when(live, "kept").otherwise("superseded")),
        F.when(live, stage("gate", F.col("accepted"), F.col("reason"))), F.when(live & F.col("accepted"), stage("final", F.lit(True), F.lit("returned"))),
    )
    return rows.select("query_id", "id", F.col("final_score").alias("score"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("query_id", "s.stage", "id", "s.passed", "s.reason", "score")


def agent_search(query: str, embedding: list[float], memories: DataFrame, history: DataFrame, now: int, user: str, scope: str = "all", project: str | None = None, budget: int = 5, custom: Mapping | None = None) -> DataFrame:
    """One question of an agent: (route, id, text). A question about a time, without filters, is answered by verified recent changes."""
    window = timeline.temporal_window(query, now) if custom is None else None
    if window:
        since, until, hours = window
        rows = timeline.recent(history, memories, now, hours, budget, scope, project, user, verified_only=True, until=until, since=since)
        return rows.select(F.lit("timeline").alias("route"), F.col("memory_id").alias("id"), F.col("memory").alias("text"))
    asked = memories.sparkSession.createDataFrame([(0, query, [float(x) for x in embedding])], "query_id int, query string, embedding array<double>")
    return find(asked, memories, user, scope, project, budget, custom).select(F.lit("search").alias("route"), "id", F.col("memory").alias("text"))
