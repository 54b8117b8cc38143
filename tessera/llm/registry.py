"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10, queries_op11, queries_op12, queries_op13

MODULES = [queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10, queries_op11, queries_op12, queries_op13]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
