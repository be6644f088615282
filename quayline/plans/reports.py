"""The named reports over goods receipts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayline.functions import scalars as S
from quayline.operators import relational as R

REPORTS: dict[str, tuple[Callable, str]] = {}


def report(description: str):
    def register(build: Callable) -> Callable:
        REPORTS[build.__name__] = (build, description)
        return build

    return register


def recent(receipts: DataFrame, as_of: date, days: int, facility: str | None) -> DataFrame:
    return R.optional_equals(
        receipts.filter(R.since("adjustment_date", as_of, days)), "facility_id", facility
    )


def money(column: str):
    return S.rounded(F.sum(column), 2)


def total(column: str, name: str):
    return F.sum(column).alias(name)


@report("Quantity totals by facility for a date range")
def facility_summary(receipts, as_of, days=7, facility=None):
    return (
        recent(receipts, as_of, days, facility)
        .groupBy("facility_id")
        .agg(
            F.count_distinct("adjustment_date").alias("days"),
            F.count_distinct("item_code").alias("unique_skus"),
            total("avl_quantity", "total_avl"),
            total("unavl_quantity", "total_unavl"),
            total("return_quantity", "total_returns"),
            money("extended_cost").alias("total_cost"),
        )
        .orderBy(F.desc("total_avl"), "facility_id")
    )


@report("Day-by-day quantity totals, optionally of one facility")
def daily_breakdown(receipts, as_of, days=7, facility=None):
    return (
        recent(receipts, as_of, days, facility)
        .groupBy("adjustment_date", "facility_id")
        .agg(
            F.count_distinct("item_code").alias("unique_skus"),
            total("avl_quantity", "total_avl"),
            total("unavl_quantity", "total_unavl"),
            total("return_quantity", "total_returns"),
        )
        .orderBy(F.desc("adjustment_date"), "facility_id")
    )


@report("Top items by available quantity received")
def top_skus(receipts, as_of, days=7, facility=None, limit=20):
    return (
        recent(receipts, as_of, days, facility)
        .groupBy("item_code", "product_name")
        .agg(
            total("avl_quantity", "total_avl"),
            total("unavl_quantity", "total_unavl"),
            F.count_distinct("adjustment_date").alias("days_active"),
            F.count_distinct("facility_id").alias("facilities"),
        )
        .orderBy(F.desc("total_avl"), "item_code", "product_name")
        .limit(limit)
    )


@report("History of one item")
def sku_detail(receipts, as_of, item_code, days=7, facility=None):
    return (
        recent(receipts, as_of, days, facility)
        .filter(F.col("item_code") == F.lit(item_code))
        .select(
            "adjustment_date", "facility_id", "avl_quantity", "unavl_quantity", "return_quantity",
            F.col("std_cost").cast("double"), F.col("extended_cost").cast("double"),
        )
        .orderBy(F.desc("adjustment_date"), "facility_id", "avl_quantity")
    )


@report("Totals by product name")
def product_summary(receipts, as_of, days=7, facility=None, limit=20):
    return (
        recent(receipts, as_of, days, facility)
        .filter(R.not_blank("product_name"))
        .groupBy("product_name")
        .agg(
            F.count_distinct("item_code").alias("sku_count"),
            total("avl_quantity", "total_avl"),
            total("unavl_quantity", "total_unavl"),
            money("extended_cost").alias("total_cost"),
        )
        .orderBy(F.desc("total_avl"), "product_name")
        .limit(limit)
    )


@report("Coverage of the data and time of the last load")
def data_freshness(receipts, runs, source_id):
    """One pass over the receipts; the run count is a scalar subquery, not a join."""
    wins = runs.filter((F.col("source_id") == source_id) & (F.col("status") == "success"))
    successful = wins.agg(F.count(F.lit(1)).alias("successful_runs")).scalar()
    return receipts.agg(
        F.max("adjustment_date").alias("latest_data_date"),
        F.min("adjustment_date").alias("earliest_data_date"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("item_code").alias("total_skus"),
        F.count_distinct("facility_id").alias("total_facilities"),
        F.max("fetched_at").alias("last_fetched"),
    ).withColumn("successful_runs", successful)


def compared_weeks(joined: DataFrame) -> DataFrame:
    this, last = S.zero_if_null(F.col("this_avl")), S.zero_if_null(F.col("last_avl"))
    return joined.select(
        "facility_id",
        this.alias("this_week_avl"),
        last.alias("last_week_avl"),
        (this - last).alias("avl_change"),
        S.percent_change(this, last).alias("avl_pct_change"),
    ).orderBy("facility_id")


@report("This week against last week by facility")
def week_over_week(receipts, as_of):
    """This week is the eight dates from `as_of - 7`; last week the seven before. One scan."""
    today = S.as_date(as_of)
    this = F.col("adjustment_date") >= F.date_sub(today, 7)
    return compared_weeks(
        receipts.filter(R.since("adjustment_date", as_of, 14))
        .groupBy("facility_id")
        .agg(
            F.sum(F.when(this, F.col("avl_quantity"))).alias("this_avl"),
            F.sum(F.when(~this, F.col("avl_quantity"))).alias("last_avl"),
        )
    )


def week_over_week_joined(receipts, as_of):
    """The same report as a full outer join of two periods."""
    today = S.as_date(as_of)
    by_facility = lambda df, name: df.groupBy("facility_id").agg(total("avl_quantity", name))
    this = by_facility(receipts.filter(R.since("adjustment_date", as_of, 7)), "this_avl")
    before = F.col("adjustment_date")
    last = by_facility(
        receipts.filter((before >= F.date_sub(today, 14)) & (before < F.date_sub(today, 7))),
        "last_avl",
    )
    return compared_weeks(this.join(last, "facility_id", "full"))


@report("Rows, quantities, items and days per facility in a window")
def collector_summary(receipts, as_of, days=7):
    return (
        recent(receipts, as_of, days, None)
        .groupBy("facility_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            total("avl_quantity", "total_avl"),
            total("unavl_quantity", "total_unavl"),
            F.count_distinct("item_code").alias("unique_skus"),
            F.count_distinct("adjustment_date").alias("days_covered"),
        )
        .orderBy("facility_id")
    )


@report("Ten largest items by available quantity in a window")
def collector_top10(receipts, as_of, days=7):
    return (
        recent(receipts, as_of, days, None)
        .groupBy("item_code", "product_name")
        .agg(total("avl_quantity", "total_avl"), total("unavl_quantity", "total_unavl"))
        .orderBy(F.desc("total_avl"), "item_code", "product_name")
        .limit(10)
        .withColumn("product_name", S.cut(F.coalesce("product_name", F.lit("")), 24))
    )


@report("Row count, dates and distinct keys of the receipts")
def table_stats(receipts):
    return receipts.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("adjustment_date").alias("earliest"),
        F.max("adjustment_date").alias("latest"),
        F.count_distinct("facility_id").alias("facilities"),
        F.count_distinct("item_code").alias("skus"),
    )


@report("Successful and failed runs")
def run_stats(runs):
    return runs.agg(
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def report_catalog(spark: SparkSession) -> DataFrame:
    """The names and descriptions of all reports."""
    rows = [(name, description) for name, (_, description) in REPORTS.items()]
    return spark.createDataFrame(rows, "name string, description string")


def run_report(name: str, *frames: DataFrame, **params) -> DataFrame:
    """Run a report by name; an unknown name lists the known ones."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; available: {sorted(REPORTS)}")
    return REPORTS[name][0](*frames, **params)
