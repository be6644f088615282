"""Checks on query results and on join keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

RESULT_SCHEMA = "name string, category string, row_count bigint, status string, error string"


def result_status(df: DataFrame, name: str, category: str) -> DataFrame:
    """OK, ZERO_ROWS, or SUSPICIOUS_ZERO when the result is one cell holding null or zero."""
    counts = [F.count(F.lit(1)).alias("row_count")]
    lone = F.lit(False)
    if len(df.columns) == 1:
        cell = F.max(F.col(df.columns[0]).cast("string")).try_cast("double")
        text = F.max(F.col(df.columns[0]).cast("string"))
        counts.append((text.isNull() | (F.coalesce(cell, F.lit(1.0)) == 0)).alias("empty_cell"))
        lone = (F.col("row_count") == 1) & F.col("empty_cell")
    status = (
        F.when(F.col("row_count") == 0, "ZERO_ROWS")
        .when(lone, "SUSPICIOUS_ZERO")
        .otherwise("OK")
    )
    return df.agg(*counts).select(
        F.lit(name).alias("name"), F.lit(category).alias("category"), "row_count",
        status.alias("status"), F.lit(None).cast("string").alias("error"),
    )


def check_results(
    spark: SparkSession, checks: dict[str, tuple[str, Callable[[], DataFrame]]]
) -> DataFrame:
    """One row per query; a query that cannot be built is an ERROR row, the others still run."""
    rows = []
    for name, (category, build) in checks.items():
        try:
            rows.append(result_status(build(), name, category))
        except Exception as error:
            failed = [(name, category, 0, "ERROR", str(error).splitlines()[0])]
            rows.append(spark.createDataFrame(failed, RESULT_SCHEMA))
    return reduce(DataFrame.unionByName, rows)


def check_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("category", "status").agg(F.count(F.lit(1)).alias("queries"))


def dup_factor(df: DataFrame, key: str) -> DataFrame:
    """Rows per distinct key."""
    rows, keys = F.count(key), F.count_distinct(key)
    return df.agg(
        rows.alias("row_count"), keys.alias("key_count"),
        F.round(rows.cast("decimal(18,0)") / keys.cast("decimal(18,0)"), 4)
        .cast("double").alias("dup_factor"),
    )


def fanout_guard(dimension: DataFrame, key: str) -> DataFrame:
    """The keys that would multiply fact rows in a join, with their row counts."""
    return (
        dimension.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )
