"""Domain views over the test tables, each column one expression that Spark and DuckDB both read.

Times are epoch seconds, so that no engine's time zone rules matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-01T00:00:00Z and the fixed present, 2024-01-30T23:59:59Z.
EPOCH, NOW = 1704067200, 1706659199

MEM = {
    "id": "CAST(doc_id AS STRING)",
    "doc_id": "doc_id",
    "memory": "text",
    "user_id": "concat('u', CAST(doc_id % 5 AS STRING))",
    "agent_id": "CASE WHEN doc_id % 4 = 0 THEN 'global' ELSE concat('p', CAST(doc_id % 3 AS STRING)) END",
    "scope": "CASE WHEN doc_id % 4 = 0 THEN 'global' ELSE 'project' END",
    "status": "CASE WHEN doc_id % 7 = 0 THEN 'superseded' WHEN doc_id % 7 = 1 THEN 'active' WHEN doc_id % 7 = 2 THEN '' END",
    "created_at": f"{EPOCH} + doc_id * 60",
    "updated_at": f"CASE WHEN doc_id % 3 <> 0 THEN {EPOCH} + doc_id * 60 + (doc_id % 97) * 3600 END",
    "last_confirmed_at": f"CASE WHEN doc_id % 5 <> 0 THEN {EPOCH} + doc_id * 45 + 86400 END",
    "confirmation_count": "CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 6 AS INT) END",
    "expiration_date": "CASE WHEN doc_id % 11 = 0 THEN concat('2024-', CASE WHEN doc_id % 2 = 0 THEN '01' ELSE '02' END, '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), CASE WHEN doc_id % 22 = 0 THEN 'T10:00:00Z' ELSE '' END) WHEN doc_id % 11 = 1 THEN 'never' END",
    "source": "CASE doc_id % 4 WHEN 0 THEN 'agent_explicit' WHEN 1 THEN 'session_distillation' WHEN 2 THEN 'import' END",
    "category": "CASE doc_id % 4 WHEN 0 THEN 'preference' WHEN 1 THEN 'decision' WHEN 2 THEN 'pitfall' ELSE 'general' END",
    "lang": "lang",
}
HIST = {
    "rowid": "event_id",
    "memory_id": "CAST(event_id % 1500 AS STRING)",
    "event": "CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'purchase' THEN 'ADD' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END",
    "old_memory": "concat('old ', event_type)",
    "new_memory": "CASE WHEN event_type <> 'error' THEN concat('new ', event_type, ' ', CAST(user_id AS STRING)) END",
    "created_at": f"CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'not a time' WHEN event_id % 2 = 0 THEN concat('2024-01-', lpad(CAST(1 + event_id % 30 AS STRING), 2, '0'), 'T', lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':00Z') ELSE concat('2024-01-', lpad(CAST(1 + event_id % 30 AS STRING), 2, '0'), ' ', lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':30') END",
    "updated_at": "CASE WHEN event_id % 3 = 0 THEN concat('2024-01-30 ', lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':', lpad(CAST((event_id * 7) % 60 AS STRING), 2, '0'), ':15') WHEN event_id % 3 = 1 THEN '' END",
}
TURNS = {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text"}
#: Queue jobs: one for each event.
JOBS = {
    "rowid": "event_id",
    "host": "CASE user_id % 4 WHEN 0 THEN 'Codex' WHEN 1 THEN 'Pi' WHEN 2 THEN 'ZCode' ELSE 'Antigravity' END",
    "session_id": "concat('s', CAST(user_id AS STRING))",
    "event": "event_type",
    "boundary": "CAST(event_id % 400 AS STRING)",
    "created_at": f"{EPOCH} + event_id * 37",
    "state": "CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'dead' WHEN 3 THEN 'skipped' WHEN 4 THEN 'coalesced' ELSE 'completed' END",
    "attempt": "CAST(event_id % 4 AS INT)",
    "not_before": f"{EPOCH} + event_id * 37 + (event_id % 5) * 3600",
    "claimed_at": f"CASE WHEN event_id % 9 = 1 THEN {NOW} - event_id % 700 END",
    "updated_at": f"CASE WHEN event_id % 8 <> 0 THEN {EPOCH} + event_id * 41 END",
    "user_id": "user_id",
    "value": "value",
}

_TABLES = {"mem": ("documents", MEM), "hist": ("events", HIST), "turns": ("conversations", TURNS), "jobs": ("events", JOBS)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """The views as common table expressions for an oracle."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _TABLES[n][1].items())} FROM {_TABLES[n][0]})" for n in names)


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def literal_cte(name: str, columns: str, rows: list[tuple]) -> str:
    """Literal rows as a common table expression."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def columns_of(select: str) -> list[str]:
    """The columns of a select over one table: cut at commas outside brackets and quotes."""
    text = select.removeprefix("SELECT ").rpartition(" FROM ")[0]
    out, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(text):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]
