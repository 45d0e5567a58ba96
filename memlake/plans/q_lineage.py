"""Lineages with shared members: merges, refusals and one whole consolidation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import consolidate as co
from memlake.operators import consolidation, journal
from memlake.plans.q_consolidate import pairs
from memlake.plans.registry import query
from memlake.plans.views import NOW, cte, view

#: A record's merged ids by its number: five levels, in which records share members; the last numbers name some that have no record.
_BELOW = ["CASE WHEN doc_id % {0} = 0 THEN CAST(doc_id + {1} AS STRING) END".format(*x) for x in ((2, 1), (4, 2), (4, 3), (8, 4), (16, 8), (32, 16))]
_RECORD = {
    "id": "id", "memory": "memory", "status": "CAST(NULL AS STRING)", "superseded_by": "CAST(NULL AS STRING)", "confirmation_count": "CAST(1 + doc_id % 90 AS INT)", "last_confirmed_at": "last_confirmed_at", "updated_at": "updated_at",
    "user_id": "CASE WHEN doc_id % 97 = 3 THEN 'other' ELSE 'u' END", "source": "source", "supersede_reason": "CAST(NULL AS STRING)",
}
_OPS = "SELECT concat('m', id, '-', CAST(n AS STRING)) AS operation_id, id AS winner_id, CAST(doc_id + n AS STRING) AS loser_id, CASE WHEN n = 3 THEN 'CONFLICT' ELSE 'EQUIVALENT' END AS relation, 'applied' AS outcome"


def records(spark, sf) -> DataFrame:
    mem = view(spark, sf, "mem")
    return mem.selectExpr(*[f"{e} AS {c}" for c, e in _RECORD.items()], f"array_compact(array({', '.join(_BELOW)})) AS merged_ids", "CAST(NULL AS ARRAY<STRING>) AS merged_sources")


def merges(spark, sf) -> DataFrame:
    mem = view(spark, sf, "mem")
    asked = spark.sql(f"{_OPS} FROM {{m}} LATERAL VIEW explode(CASE WHEN doc_id % 32 = 0 THEN array(12, 18) WHEN doc_id % 32 = 27 THEN array(3) END) AS n", m=mem)
    return asked.join(mem.select(F.col("id").alias("loser_id")), "loser_id", "left_semi")


_SQL = f"""{cte('mem')}, r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _RECORD.items())}, doc_id, CASE WHEN doc_id % 32 = 0 THEN 5 WHEN doc_id % 16 = 0 THEN 4 WHEN doc_id % 8 = 0 THEN 3 WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS level, list_filter([{', '.join(_BELOW)}], lambda x: x IS NOT NULL) AS merged_ids FROM mem),
e AS (SELECT id AS m, unnest(merged_ids) AS d FROM r),
cl AS (SELECT m, d FROM e UNION SELECT cl.m, e.d FROM cl JOIN e ON e.m = cl.d),
own0 AS (SELECT id, confirmation_count AS own FROM r WHERE level = 0 UNION SELECT d, 1 FROM e WHERE d NOT IN (SELECT id FROM r)),
""" + ",\n".join(f"own{k} AS (SELECT * FROM own{k - 1} UNION ALL SELECT r.id, greatest(1, any_value(confirmation_count) - sum(own)) FROM r JOIN cl ON cl.m = r.id JOIN own{k - 1} o ON o.id = cl.d WHERE level = {k} GROUP BY r.id)" for k in range(1, 6)) + f""",
op AS ({_OPS} FROM (SELECT *, unnest(CASE WHEN doc_id % 32 = 0 THEN [12, 18] WHEN doc_id % 32 = 27 THEN [3] END) AS n FROM r) WHERE doc_id + n IN (SELECT doc_id FROM r)),
ends AS (SELECT operation_id, winner_id, unnest([winner_id, loser_id]) AS m FROM op WHERE relation = 'EQUIVALENT'),
held AS (SELECT operation_id, winner_id, m AS d FROM ends UNION SELECT operation_id, winner_id, d FROM ends JOIN cl USING (m)),
bad AS (SELECT DISTINCT operation_id FROM held JOIN r w ON w.id = winner_id JOIN r x ON x.id = d WHERE x.user_id <> w.user_id),
out AS (SELECT op.*, CASE WHEN operation_id IN (FROM bad) THEN 'cross_identity_lineage' ELSE outcome END AS said FROM op),
un AS (SELECT DISTINCT winner_id, d FROM held WHERE operation_id NOT IN (FROM bad)),
got AS (SELECT winner_id AS id, sum(own) AS n, string_agg(d, ',' ORDER BY d) FILTER (WHERE d <> winner_id) AS ids, max(last_confirmed_at) AS fresh, array_to_string(list_sort(list_distinct(list(source) FILTER (WHERE source IS NOT NULL))), ',') AS sources FROM un JOIN own5 o ON o.id = d LEFT JOIN r ON r.id = d GROUP BY winner_id),
lost AS (SELECT loser_id AS id, min(winner_id) AS by_id, arg_min(relation, winner_id) AS kind FROM out WHERE said = 'applied' GROUP BY loser_id)"""


@query("apply_lineage_outcomes", f"WITH RECURSIVE {_SQL} SELECT operation_id, winner_id, loser_id, said AS outcome FROM out")
def apply_lineage_outcomes(spark, sf):
    return journal.absorbed(records(spark, sf), merges(spark, sf))[1].select("operation_id", "winner_id", "loser_id", "outcome")


@query("apply_lineage", f"""WITH RECURSIVE {_SQL} SELECT r.id, CASE WHEN lost.id IS NOT NULL THEN 'superseded' ELSE status END AS status, by_id AS superseded_by, CAST(coalesce(n, confirmation_count) AS INT) AS confirmation_count, coalesce(ids, array_to_string(merged_ids, ',')) AS merged_ids,
 CASE WHEN got.id IS NOT NULL THEN greatest(last_confirmed_at, fresh) ELSE last_confirmed_at END AS last_confirmed_at, sources AS merged_sources, CASE kind WHEN 'EQUIVALENT' THEN 'equivalent_merged' WHEN 'CONFLICT' THEN 'conflict_overridden' END AS supersede_reason, CASE WHEN got.id IS NOT NULL OR lost.id IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at
 FROM r LEFT JOIN got ON got.id = r.id LEFT JOIN lost ON lost.id = r.id""")
def apply_lineage(spark, sf):
    after, _ = journal.applied(records(spark, sf), merges(spark, sf), NOW)
    return after.select("id", "status", "superseded_by", "confirmation_count", F.array_join("merged_ids", ",").alias("merged_ids"), "last_confirmed_at", F.array_join("merged_sources", ",").alias("merged_sources"), "supersede_reason", "updated_at")


@query("lineage_own", f"WITH RECURSIVE {_SQL} SELECT id, CAST(own AS BIGINT) AS own FROM own5 WHERE id IN (SELECT id FROM r)")
def lineage_own(spark, sf):
    return co.own_counts(records(spark, sf).withColumnRenamed("confirmation_count", "count"))


@query("consolidation_run")
def consolidation_run(spark, sf):
    """All records after one run over the decided pairs of equal texts; the order of chained pairs matters, so tests compare it with a loop."""
    mem = view(spark, sf, "mem").select("id", "memory", "status", "source", "created_at", F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("array<string>").alias("merged_ids"), "confirmation_count", "last_confirmed_at", "updated_at")
    decided = pairs(spark, sf).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.when(F.expr("n_b % 9 = 0"), "CONFLICT").otherwise("EQUIVALENT").alias("relation"))
    none = spark.createDataFrame([], "operation_id string, status string")
    open_plan = spark.createDataFrame([], ", ".join(f"{c} string" for c in consolidation.PLAN))
    after, _, _ = consolidation.run(mem, decided, open_plan, none, NOW)
    return after.select("id", "status", "superseded_by", "confirmation_count", F.array_join("merged_ids", ",").alias("merged_ids"), "last_confirmed_at", "updated_at")
