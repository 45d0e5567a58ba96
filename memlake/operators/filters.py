"""Filter dictionaries compiled to predicates, and the scope, lifecycle, expiration and ownership filters."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
}


def compile_filter(spec: Mapping) -> Column:
    """A filter dictionary as a predicate: equality, a list (IN), {operator: value}, AND, OR, NOT.

    Unknown operators are an error: a filter must not widen by being misread.
    """
    out = F.lit(True)
    for key, value in spec.items():
        if key in ("AND", "OR", "NOT"):
            parts = [compile_filter(x) for x in (value if isinstance(value, list) else [value])]
            if not parts:
                raise ValueError(f"{key} needs at least one filter")
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "AND" else joined | p
            # NOT of a list: none of them; an unknown value doesn't match
            out = out & (~F.coalesce(joined, F.lit(False)) if key == "NOT" else joined)
        elif isinstance(value, Mapping):
            for op, v in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown filter operator {op!r}")
                out = out & _COMPARE[op](F.col(key), v)
        elif isinstance(value, (list, tuple, set)):
            out = out & F.col(key).isin(list(value))
        elif value is None:
            out = out & F.col(key).isNull()
        else:
            out = out & (F.col(key) == value)
    return out


def scope_filter(scope: str, user: str, project: str | None = None) -> dict:
    """Global, project, or all (the project's and global), always of one user."""
    if scope == "global":
        return {"user_id": user, "agent_id": "global"}
    if scope not in ("project", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    if not project:
        raise ValueError("this scope needs a project")
    return {"user_id": user, "agent_id": project if scope == "project" else ["global", project]}


def compose(mandatory: Mapping, custom: Mapping | None) -> dict:
    """Both filters: a caller's can only narrow."""
    return {"AND": [dict(mandatory), dict(custom)]} if custom else dict(mandatory)


def status_of(status: str = "status") -> Column:
    return F.coalesce(F.nullif(F.col(status), F.lit("")), F.lit("active"))


def active(status: str = "status") -> Column:
    """Not superseded; a missing or empty status is active."""
    return status_of(status) != "superseded"


def expired(column: str, today: date) -> Column:
    """The date part lies before today; what can't be read as a date has not expired."""
    day = F.try_to_date(F.substring_index(F.col(column), "T", 1), "yyyy-MM-dd")
    return F.coalesce(day < F.lit(today), F.lit(False))


def guarded_scan(df: DataFrame, limit: int) -> DataFrame:
    """df if it has at most limit rows; counts no further than that."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows in scope")
    return df


def guarded_identity(memories: DataFrame, today: date, limit: int) -> DataFrame:
    """Memories that haven't expired, if there are at most limit rows even with those that have: two probes, neither counts further than that."""
    guarded_scan(memories, limit)
    return guarded_scan(memories.where(~expired("expiration_date", today)), limit)


#: What an explicit memory may be.
CATEGORIES, MAX_TEXT = ("preference", "decision", "pitfall", "general"), 2000


def validate_addition(text: str, scope: str, category: str) -> str:
    """The text of an explicit memory, trimmed."""
    clean = (text or "").strip()
    if not clean:
        raise ValueError("text must not be empty")
    if len(clean) > MAX_TEXT:
        raise ValueError(f"text has {len(clean)} characters, at most {MAX_TEXT} are allowed")
    if scope not in ("project", "global"):
        raise ValueError(f"unknown scope {scope!r}")
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    return clean


def ingest_budget(corpus: DataFrame, max_items: int, max_cost: float, per_million_tokens: float, tokens: Column) -> DataFrame:
    """(items, tokens, cost, verdict) of a corpus before it is embedded: ok, too_many_items or too_costly. tokens: an estimate for each row."""
    if max_items <= 0 or max_cost < 0 or per_million_tokens < 0:
        raise ValueError("a budget must not be negative, and allow an item")
    found = corpus.agg(F.count("*").alias("items"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"))
    cost = F.col("tokens") / 1_000_000 * per_million_tokens
    why = F.when(F.col("items") > max_items, "too_many_items").when(cost > max_cost, "too_costly").otherwise("ok")
    return found.select("items", "tokens", F.round(cost, 6).alias("cost"), why.alias("verdict"))


def validate_recent(hours: int, limit: int, scope: str) -> None:
    if isinstance(hours, bool) or not isinstance(hours, int) or not 1 <= hours <= 8760:
        raise ValueError("hours must be an integer from 1 to 8760")
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError("limit must be an integer")
    if scope not in ("all", "project", "global"):
        raise ValueError(f"unknown scope {scope!r}")
