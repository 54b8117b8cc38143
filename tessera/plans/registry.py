"""Registered queries of the analytics operators and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, duck_sql
from .shared import checkpoint_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
MODULES = ("corpus_queries", "facts_queries", "crossrepo_queries", "qa_queries", "docs_queries", "decision_queries", "metrics_queries", "graph_queries", "event_queries")


def register(name: str, query: Callable[[Inputs], DataFrame], fixtures: str = "", sql: str = "") -> None:
    """A query over the inputs, and SQL for DuckDB behind the CTEs of the named fixtures. sql starts with SELECT or with a comma and further CTEs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoint_dir(spark)
        return query(Inputs(spark, sf_dir))

    _QUERIES[name] = run
    if sql:
        ctes = duck_sql(tuple(fixtures.split()))
        body = sql.strip()
        if body.startswith(","):
            body = body if ctes else body[1:]
            _ORACLE[name] = f"WITH RECURSIVE {ctes} {body}"
        else:
            _ORACLE[name] = f"WITH {ctes} {body}" if ctes else body


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tessera.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client calls matched to backend routes across repositories."""
    return queries()["jn3_match_calls_to_routes"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
