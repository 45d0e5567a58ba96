"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) query, with its SQL twin where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from memlake.plans import q_consolidate, q_evaluate, q_journal, q_lineage, q_queue, q_records, q_scope, q_search, q_sources, q_text  # noqa: F401


_load()
