"""Recent changes: a time range of the journal, joined to what is known of each memory, newest first."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.filters import active, validate_recent

MAX_ROWS, DEFAULT_HOURS, MAX_HOURS = 100, 24, 8760


def instant(text: Column) -> Column:
    """ISO text, with T or space, with or without zone, as a UTC timestamp; anything else null."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def event_time() -> Column:
    """When an event happened: updated_at if it says something, else created_at."""
    return instant(F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.col("created_at")))


def recent(history: DataFrame, memories: DataFrame, now: int, hours: int = DEFAULT_HOURS, limit: int = 50, scope: str = "all", project: str | None = None, user: str | None = None, verified_only: bool = False, until: int | None = None, since: int | None = None, zone: str = "UTC") -> DataFrame:
    """Events of the window [since, or else now - hours, until) that the user may see.

    memories: id, user_id, agent_id, status. Events without a known memory stay
    unless verified_only. The side that is joined is chosen by Catalyst's size
    statistics; the range and the columns reach the scan. zone: that of the local
    time shown beside UTC.
    """
    validate_recent(hours, limit, scope)
    when = event_time()
    rows = history.withColumn("event_ts", when).where(F.col("event_ts") >= F.timestamp_seconds(F.lit(now - hours * 3600 if since is None else since)))
    if until is not None:
        rows = rows.where(F.col("event_ts") < F.timestamp_seconds(F.lit(until)))
    known = memories.select(F.col("id").alias("memory_id"), F.col("user_id").alias("owner"), F.col("agent_id").alias("place"), F.col("status").alias("m_status"), F.lit(True).alias("known"))
    rows = rows.join(known, "memory_id", "left").where(F.col("known").isNull() | active("m_status"))
    if user is not None:
        rows = rows.where(F.col("owner").isNull() | (F.col("owner") == user))
    if verified_only:
        rows = rows.where(F.col("known") & F.col("place").isNotNull() & (F.col("owner") == user if user is not None else F.lit(True)))
    place = F.col("place")
    if scope == "global":
        rows = rows.where(place == "global")
    elif scope == "project":
        rows = rows.where(place == project)
    elif project is not None:
        rows = rows.where(place.isNull() | place.isin("global", project))
    shown = F.when(F.col("event") == "DELETE", F.col("old_memory")).otherwise(F.col("new_memory"))
    rows = rows.orderBy(F.desc("event_ts"), F.desc("rowid")).limit(max(0, min(limit, MAX_ROWS)))
    return rows.select("rowid", "memory_id", "event", place.alias("scope"), shown.alias("memory"), F.date_format(F.from_utc_timestamp("event_ts", zone), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("created_at_utc"))


def temporal_window(query: str, now: int) -> tuple[int, int | None, int] | None:
    """(since, until, hours) of a query that asks for yesterday, today or a recent period; None for topical queries.

    Days are UTC days. The first rule that matches holds.
    """
    text = (query or "").strip()
    low, day = text.lower(), now - now % 86400
    if "昨天" in text or "昨日" in text or re.search(r"\byesterday\b", low):
        return day - 86400, day, 24
    if "今天" in text or "今日" in text or re.search(r"\btoday\b", low):
        return day, None, max(1, math.ceil(max(now - day, 1) / 3600))
    zh = re.search(r"(?:近|最近|过去)\s*(\d+)\s*(小时|时|天|日|周)", text)
    en = re.search(r"\b(?:last|past)\s+(\d+)\s*(hour|day|week)s?\b", low)
    if zh or en:
        n, unit = (zh or en).groups()
        hours = min(max(int(n) * {"小时": 1, "时": 1, "hour": 1, "周": 168, "week": 168}.get(unit, 24), 1), MAX_HOURS)
        return now - hours * 3600, None, hours
    if re.search(r"最近|近期", text) or re.search(r"\brecent(?:ly)?\b", low):
        return now - DEFAULT_HOURS * 3600, None, DEFAULT_HOURS
    return None


def temporal_route(queries: DataFrame, column: str = "query") -> DataFrame:
    """The same rules for a table of queries: route (timeline or search), label and hours."""
    q, low = F.trim(F.col(column)), F.lower(F.trim(F.col(column)))
    zh, en = r"(?:近|最近|过去)\s*(\d+)\s*(小时|时|天|日|周)", r"\b(?:last|past)\s+(\d+)\s*(hour|day|week)s?\b"
    n = F.when(q.rlike(zh), F.regexp_extract(q, zh, 1)).when(low.rlike(en), F.regexp_extract(low, en, 1))
    unit = F.when(q.rlike(zh), F.regexp_extract(q, zh, 2)).when(low.rlike(en), F.regexp_extract(low, en, 2))
    size = F.when(unit.isin("小时", "时", "hour"), 1).when(unit.isin("周", "week"), 168).otherwise(24)
    label = (
        F.when(q.contains("昨天") | q.contains("昨日") | low.rlike(r"\byesterday\b"), "yesterday")
        .when(q.contains("今天") | q.contains("今日") | low.rlike(r"\btoday\b"), "today")
        .when(n.isNotNull(), "period")
        .when(q.rlike("最近|近期") | low.rlike(r"\brecent(?:ly)?\b"), "recent")
    )
    hours = F.when(label == "period", F.least(F.greatest(F.try_to_number(n, F.lit("999999999")).cast("int") * size, F.lit(1)), F.lit(MAX_HOURS))).when(label.isin("yesterday", "recent"), F.lit(24))
    return queries.select("*", F.when(label.isNotNull(), "timeline").otherwise("search").alias("route"), label.alias("label"), hours.cast("int").alias("hours"))
