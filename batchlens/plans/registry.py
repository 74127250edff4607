"""Query registry: name -> (Spark builder, optional oracle SQL text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query builder; ``sql`` (text or a thunk) is its oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql  # text or thunk, evaluated lazily by oracles()
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from batchlens.plans import q_adaptive, q_analytics, q_branches, q_compare, q_core, q_decision, q_feeds, q_io, q_learning, q_misc, q_reports, q_stream, q_versions  # noqa: F401


def oracles() -> dict[str, str]:
    return {k: (v() if callable(v) else v) for k, v in ORACLES.items()}
