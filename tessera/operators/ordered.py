"""Numbered rows of a distributed table, and comparison of two tables row by row in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """df with the number (from 1) of each row in an order, without a task that sees all rows: rows are dealt by ranges and sorted within them, each range is
    counted, and a row's number is its place in its range behind the rows of the ranges before. Rows that tie in the order are ordered by their columns."""
    ties = [F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})]
    placed = df.orderBy(*order, *ties).withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "ordered")  # the numbers of ranges stand still from here on
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    out = placed.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return out.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def row_differences(actual: DataFrame, expected: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of actual, in an order, that are not those of expected(row_no, columns) at the same number: row_no, column, and both values as text (null where
    a side has no such row). Only the given columns are compared, by default those of expected; null equals null."""
    columns = columns or [c for c in expected.columns if c != "row_no"]
    a = numbered(actual, order).select("row_no", F.struct(*columns).alias("a"))
    both = a.join(expected.select("row_no", F.struct(*columns).alias("e")), "row_no", "full")
    has = lambda side: F.col(side).isNotNull()
    cell = lambda c: F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")) | ~has("a") | ~has("e"), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("actual"), F.col(f"e.{c}").cast("string").alias("expected")))
    return both.select("row_no", F.explode(F.array_compact(F.array(*map(cell, columns)))).alias("d")).select("row_no", "d.*")


def ordered_match(actual: DataFrame, expected: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: whether all rows match in order, the number of the first that differs, and how many do."""
    wrong = row_differences(actual, expected, order, columns)
    return wrong.agg((F.count("*") == 0).alias("passed"), F.min("row_no").alias("first_difference"), F.count_distinct("row_no").alias("rows_differ"))


def first_row_match(actual: DataFrame, order: list[str], expected: dict) -> DataFrame:
    """One row: whether the first row in an order has the expected values in the named columns; an empty table has no first row and fails."""
    first = actual.agg(F.min_by(F.struct(*expected), F.struct(*order)).alias("first"), F.count("*").alias("n"))
    ok = F.col("n") > 0
    for c, v in expected.items():
        ok = ok & F.col(f"first.{c}").eqNullSafe(F.lit(v))
    return first.select(ok.alias("passed"), F.col("n").alias("actual_count"))
