"""Scope, lifecycle, lookups and the timeline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from memlake.operators import filters as flt
from memlake.operators import timeline
from memlake.plans.registry import query
from memlake.plans.views import NOW, cte, literal_cte, view

USER, PROJECT = "u2", "p1"
TODAY = date(2024, 1, 30)
_ACTIVE = "coalesce(nullif(status, ''), 'active') <> 'superseded'"
_FIELDS = ("id", "user_id", "agent_id", "status", "category")
_SELECT = ", ".join(_FIELDS)


def _scope(scope: str, where: str):
    @query(f"scope_filter_{scope}", f"WITH {cte('mem')} SELECT {_SELECT} FROM mem WHERE user_id = '{USER}' AND {where}")
    def run(spark, sf):
        return view(spark, sf, "mem").where(flt.compile_filter(flt.scope_filter(scope, USER, PROJECT))).select(*_FIELDS)


_scope("all", f"agent_id IN ('global', '{PROJECT}')")
_scope("project", f"agent_id = '{PROJECT}'")
_scope("global", "agent_id = 'global'")


@query("scope_compose_narrowing", f"WITH {cte('mem')} SELECT {_SELECT} FROM mem WHERE user_id = '{USER}' AND agent_id IN ('global', '{PROJECT}') AND (category IN ('decision', 'general') OR confirmation_count >= 3) AND NOT coalesce(status = 'superseded', false) AND created_at < {NOW}")
def scope_compose(spark, sf):
    custom = {"OR": [{"category": ["decision", "general"]}, {"confirmation_count": {"gte": 3}}], "NOT": [{"status": "superseded"}], "created_at": {"lt": NOW}}
    return view(spark, sf, "mem").where(flt.compile_filter(flt.compose(flt.scope_filter("all", USER, PROJECT), custom))).select(*_FIELDS)


@query("scope_widening_denied", f"WITH {cte('mem')} SELECT count(*) AS n FROM mem WHERE user_id = '{USER}' AND agent_id = '{PROJECT}' AND user_id = 'u3'")
def scope_widening(spark, sf):
    return view(spark, sf, "mem").where(flt.compile_filter(flt.compose(flt.scope_filter("project", USER, PROJECT), {"user_id": "u3"}))).agg(F.count("*").alias("n"))


@query("lifecycle_active", f"WITH {cte('mem')} SELECT user_id, count(*) AS n FROM mem WHERE {_ACTIVE} GROUP BY user_id")
def lifecycle_active(spark, sf):
    return view(spark, sf, "mem").where(flt.active()).groupBy("user_id").agg(F.count("*").alias("n"))


@query("lifecycle_rejects", f"WITH {cte('mem')} SELECT id, coalesce(nullif(status, ''), 'active') AS status, 'superseded' AS reason FROM mem WHERE NOT ({_ACTIVE})")
def lifecycle_rejects(spark, sf):
    return view(spark, sf, "mem").where(~flt.active()).select("id", flt.status_of().alias("status"), F.lit("superseded").alias("reason"))


@query("expiration_filter", f"WITH {cte('mem')} SELECT id, expiration_date, coalesce(try_cast(split_part(expiration_date, 'T', 1) AS DATE) < DATE '{TODAY}', false) AS expired FROM mem")
def expiration(spark, sf):
    return view(spark, sf, "mem").select("id", "expiration_date", flt.expired("expiration_date", TODAY).alias("expired"))


@query("point_lookup", f"WITH {cte('mem')} SELECT id, memory, user_id FROM mem WHERE id = '42'")
def point_lookup(spark, sf):
    return view(spark, sf, "mem").where("id = '42'").select("id", "memory", "user_id")


@query("multi_get", f"WITH {cte('mem', 'hist')}, want AS (SELECT memory_id, min(rowid) AS first_seen FROM hist GROUP BY memory_id) SELECT memory_id AS id, first_seen, user_id, agent_id FROM want JOIN mem ON mem.id = want.memory_id")
def multi_get(spark, sf):
    # ids once each, in the order they first occur; missing ids are absent
    want = view(spark, sf, "hist").groupBy(F.col("memory_id").alias("id")).agg(F.min("rowid").alias("first_seen"))
    return want.join(view(spark, sf, "mem"), "id").select("id", "first_seen", "user_id", "agent_id")


@query("list_memories", f"WITH {cte('mem')} SELECT id, agent_id, created_at FROM mem WHERE user_id = '{USER}' AND {_ACTIVE} AND NOT coalesce(try_cast(split_part(expiration_date, 'T', 1) AS DATE) < DATE '{TODAY}', false) ORDER BY created_at DESC, id LIMIT 100")
def list_memories(spark, sf):
    rows = view(spark, sf, "mem").where((F.col("user_id") == USER) & flt.active() & ~flt.expired("expiration_date", TODAY))
    return rows.orderBy(F.desc("created_at"), "id").limit(100).select("id", "agent_id", "created_at")


@query("list_entities", f"WITH {cte('mem')}, top AS (SELECT * FROM mem WHERE {_ACTIVE} ORDER BY doc_id LIMIT 500) SELECT 'agent' AS kind, agent_id AS name, count(*) AS n FROM top GROUP BY agent_id UNION ALL SELECT 'user', user_id, count(*) FROM top GROUP BY user_id")
def list_entities(spark, sf):
    top = view(spark, sf, "mem").where(flt.active()).orderBy("doc_id").limit(500)
    pairs = top.select(F.explode(F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("name")), F.struct(F.lit("agent").alias("kind"), F.col("agent_id").alias("name")))).alias("p"))
    return pairs.groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))


@query("user_profile", f"WITH {cte('mem')}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY doc_id) AS k FROM mem WHERE agent_id = 'global' AND {_ACTIVE}) SELECT user_id, max(k) AS n, string_agg(concat('- ', category, ' ', id), chr(10) ORDER BY doc_id) FILTER (WHERE k <= 50) AS bullets FROM t GROUP BY user_id")
def user_profile(spark, sf):
    from pyspark.sql.window import Window

    rows = view(spark, sf, "mem").where((F.col("agent_id") == "global") & flt.active())
    counts = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    # a limit by row_number is pushed into the sort of each partition before the shuffle
    first = rows.select("user_id", "doc_id", F.concat(F.lit("- "), "category", F.lit(" "), "id").alias("line"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("doc_id"))).where("k <= 50")
    text = first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n").alias("bullets"))
    return counts.join(text, "user_id").select("user_id", F.col("n").cast("bigint").alias("n"), "bullets")


def _timeline(name: str, where: str, hours: int = 24, **options):
    since = NOW - hours * 3600
    stamp = "epoch(try_cast(nullif(coalesce(nullif(updated_at, ''), created_at), '') AS TIMESTAMP))"
    sql = (
        f"WITH {cte('hist', 'mem')}, h AS (SELECT rowid, memory_id, event, old_memory, new_memory, {stamp} AS ts FROM hist), "
        f"j AS (SELECT h.*, m.id AS known, m.user_id AS owner, m.agent_id AS place, m.status FROM h LEFT JOIN mem m ON m.id = h.memory_id WHERE ts >= {since}) "
        f"SELECT rowid, memory_id, event, place AS scope, CASE WHEN event = 'DELETE' THEN old_memory ELSE new_memory END AS memory, strftime(make_timestamp((CAST(ts AS BIGINT) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp, strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at_utc "
        f"FROM j WHERE (known IS NULL OR {_ACTIVE}) AND (owner IS NULL OR owner = '{USER}') AND {where} ORDER BY ts DESC, rowid DESC LIMIT 100"
    )

    @query(name, sql)
    def run(spark, sf):
        return timeline.recent(view(spark, sf, "hist"), view(spark, sf, "mem"), NOW, hours=hours, limit=100, user=USER, zone="+08:00", **options)


_timeline("recent_timeline_all", f"(place IS NULL OR place IN ('global', '{PROJECT}'))", scope="all", project=PROJECT)
_timeline("recent_timeline_project", f"place = '{PROJECT}'", hours=720, scope="project", project=PROJECT)
_timeline("recent_timeline_global", "place = 'global'", hours=240, scope="global")
_timeline("recent_timeline_verified", f"known IS NOT NULL AND owner = '{USER}' AND place IN ('global', '{PROJECT}')", scope="all", project=PROJECT, verified_only=True)

_ROUTES = [(1, "what changed yesterday"), (2, "show me today"), (3, "last 3 days"), (4, "past 2 weeks please"), (5, "最近 5 天"), (6, "近期改动"), (7, "昨天做了什么"), (8, "which database port"), (9, "recently added"), (10, "past 1 hour"), (11, "过去 2 周"), (12, "last 99999 weeks")]
_ZH, _EN = r"(?:近|最近|过去)\s*(\d+)\s*(小时|时|天|日|周)", r"\b(?:last|past)\s+(\d+)\s*(hour|day|week)s?\b"


@query(
    "temporal_intent_route",
    f"""WITH {literal_cte('q', 'query_id, query', _ROUTES)},
x AS (SELECT *, lower(query) AS low, CASE WHEN regexp_matches(query, '{_ZH}') THEN regexp_extract(query, '{_ZH}', 1) WHEN regexp_matches(lower(query), '{_EN}') THEN regexp_extract(lower(query), '{_EN}', 1) END AS n,
 CASE WHEN regexp_matches(query, '{_ZH}') THEN regexp_extract(query, '{_ZH}', 2) WHEN regexp_matches(lower(query), '{_EN}') THEN regexp_extract(lower(query), '{_EN}', 2) END AS unit FROM q),
y AS (SELECT *, CASE WHEN contains(query, '昨天') OR contains(query, '昨日') OR regexp_matches(low, '\\byesterday\\b') THEN 'yesterday' WHEN contains(query, '今天') OR contains(query, '今日') OR regexp_matches(low, '\\btoday\\b') THEN 'today'
 WHEN n IS NOT NULL THEN 'period' WHEN regexp_matches(query, '最近|近期') OR regexp_matches(low, '\\brecent(?:ly)?\\b') THEN 'recent' END AS label FROM x)
SELECT query_id, CASE WHEN label IS NOT NULL THEN 'timeline' ELSE 'search' END AS route, label,
 CAST(CASE WHEN label = 'period' THEN least(greatest(CAST(n AS INT) * CASE WHEN unit IN ('小时', '时', 'hour') THEN 1 WHEN unit IN ('周', 'week') THEN 168 ELSE 24 END, 1), 8760) WHEN label IN ('yesterday', 'recent') THEN 24 END AS INT) AS hours FROM y""",
)
def temporal_intent(spark, sf):
    return timeline.temporal_route(spark.createDataFrame(_ROUTES, "query_id int, query string")).select("query_id", "route", "label", "hours")
