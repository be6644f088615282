"""The fixed analytic questions, one parameterised function each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from quayline import config
from quayline.functions import scalars as S
from quayline.operators import relational as R
from quayline.operators.triage import late_flags


def count_as(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def facility_array(column: str = "facilities") -> Column:
    return F.split(F.col(column), ", ")


def shipped_from(orders: DataFrame, facility: str) -> DataFrame:
    return orders.filter(F.array_contains(facility_array(), facility))


def on_day(column: str, day: date) -> Column:
    return F.col(column) == S.as_date(day)


def this_week(column: str, as_of: date) -> Column:
    """From Monday through `as_of`."""
    today = S.as_date(as_of)
    return F.col(column).between(S.week_start(today), today)


def last_week(column: str, as_of: date) -> Column:
    monday = S.week_start(S.as_date(as_of))
    return (F.col(column) >= F.date_sub(monday, 7)) & (F.col(column) < monday)


def month_start(as_of: date, back: int = 0) -> Column:
    return F.add_months(F.trunc(S.as_date(as_of), "month"), -back)


def this_month(column: str, as_of: date) -> Column:
    return F.col(column).between(month_start(as_of), S.as_date(as_of))


def last_month(column: str, as_of: date) -> Column:
    return (F.col(column) >= month_start(as_of, 1)) & (F.col(column) < month_start(as_of))


# --- delivery ----------------------------------------------------------------------------------

def orders_shipped_on(orders, facility, day):
    return count_as(
        shipped_from(orders, facility).filter(on_day("first_ship_date", day)), "orders_shipped"
    )


def orders_shipped_this_week(orders, facility, as_of):
    return count_as(
        shipped_from(orders, facility).filter(this_week("first_ship_date", as_of)), "orders_shipped"
    )


def orders_shipped_late(orders, facility, day):
    late = F.col("processing_days") > config.LATE_SHIP_DAYS
    return count_as(
        shipped_from(orders, facility).filter(on_day("first_ship_date", day) & late), "late_orders"
    )


def stuck_at_warehouse(orders, as_of, days=3):
    return count_as(late_flags(orders, as_of, days).filter("stuck_at_warehouse"), "stuck_orders")


def avg_transit_last_week(orders, as_of):
    average = F.sum("transit_days").cast("decimal(20,0)") / F.count("transit_days").cast("decimal(18,0)")
    return orders.filter(last_week("first_ship_date", as_of)).agg(
        F.round(average, 2).cast("double").alias("avg_transit_days")
    )


def top_facility_shipped(orders, day):
    return (
        orders.filter(on_day("first_ship_date", day))
        .select(F.explode(facility_array()).alias("facility"))
        .groupBy("facility")
        .agg(F.count(F.lit(1)).alias("orders_shipped"))
        .orderBy(F.desc("orders_shipped"), "facility")
        .limit(1)
    )


def cancelled_last_week(orders, as_of):
    cancelled = F.col("order_status") == "CANCELLED"
    return count_as(orders.filter(cancelled & last_week("ordered_date", as_of)), "cancelled_orders")


def undelivered(orders, as_of, days=7):
    still_open = ~F.col("order_status").isin(config.CLOSED_ORDER_STATUSES)
    return count_as(
        orders.filter(still_open & R.since("ordered_date", as_of, days)), "undelivered_orders"
    )


# --- inventory ---------------------------------------------------------------------------------

def by_snapshot(onhand: DataFrame, *keys: str) -> DataFrame:
    """Quantities per facility, snapshot and further keys; the rows left grow with the calendar."""
    return onhand.groupBy("facility", "snapshot_date", *keys).agg(
        F.sum("onhand_quantity").alias("onhand_quantity")
    )


def current_by_facility(onhand: DataFrame) -> DataFrame:
    """Each facility's stock at its own latest snapshot, without a join."""
    return (
        by_snapshot(onhand)
        .groupBy("facility")
        .agg(
            F.max("snapshot_date").alias("snapshot_date"),
            F.max_by("onhand_quantity", "snapshot_date").alias("onhand_quantity"),
        )
    )


def inventory_at_facility(onhand, facility):
    return current_by_facility(onhand.filter(F.col("facility") == F.lit(facility)))


def inventory_of_item(onhand, item):
    """The item's stock per facility at the facility's own latest snapshot, and in total."""
    latest = R.at_latest_per_group(onhand, "facility", "snapshot_date")
    return (
        latest.filter(F.col("item_code") == F.lit(item))
        .agg(F.coalesce(F.sum("onhand_quantity"), F.lit(0)).alias("onhand_quantity"))
    )


def top_inventory_facility(onhand):
    return (
        current_by_facility(onhand)
        .select("facility", "onhand_quantity")
        .orderBy(F.desc("onhand_quantity"), "facility")
        .limit(1)
    )


def top_items_at_facility(onhand, facility, limit=10):
    here = onhand.filter(F.col("facility") == F.lit(facility))
    return (
        R.at_latest_per_group(here, "facility", "snapshot_date")
        .groupBy("item_code")
        .agg(F.sum("onhand_quantity").alias("onhand_quantity"))
        .orderBy(F.desc("onhand_quantity"), "item_code")
        .limit(limit)
    )


# --- inbound -----------------------------------------------------------------------------------

def inbound_on(inbound, facility, day):
    return (
        inbound.filter((F.col("facility") == facility) & (F.col("inbound_date") == str(day)))
        .groupBy("sku", "item_description")
        .agg(F.sum("avl_quantity").alias("avl_quantity"))
    )


def inbound_receipts_this_week(receipts, facility, as_of):
    here = receipts.filter(F.col("facility_id") == facility)
    return count_as(here.filter(this_week("adjustment_date", as_of)), "receipts")


def recent_discrepancies(discrepancies, as_of, days=7):
    return discrepancies.filter(
        R.since("doc_date", as_of, days) & (F.col("discrepancy_type") != "MATCH")
    )


# --- retail ------------------------------------------------------------------------------------

def of_party(lines: DataFrame, name: str) -> DataFrame:
    """Customers are named by long legal names, so a name is matched anywhere in the party."""
    return lines.filter(F.contains("party_name", F.lit(name)))


def units_to_customer(lines, item, party, start, end):
    """Units per party: a name may cover several regional parties."""
    shipped = (F.col("ship_date") >= S.as_date(start)) & (F.col("ship_date") < S.as_date(end))
    return (
        of_party(lines, party)
        .filter((F.col("item_number") == F.lit(item)) & shipped)
        .groupBy("party_name")
        .agg(F.sum("shipped_quantity").alias("units"))
    )


def price_of_item(lines, item, party):
    return (
        of_party(lines, party)
        .filter(F.col("item_number") == F.lit(item))
        .select("party_name", F.col("unit_selling_price").cast("double"))
        .distinct()
    )


def open_orders(lines, party):
    return (
        of_party(lines, party)
        .filter(~F.col("status_code").isin("CLOSED", "CANCELLED"))
        .groupBy("order_number", "customer_po_number", "party_name")
        .agg(
            F.sum("ordered_qty").alias("ordered_qty"),
            F.sum("shipped_quantity").alias("shipped_quantity"),
        )
    )


def exceptions_this_week(exceptions, as_of):
    return (
        exceptions.filter(this_week("ordered_date", as_of))
        .groupBy("error_category")
        .agg(F.count(F.lit(1)).alias("exceptions"))
    )


def customer_orders_last_month(lines, party, as_of):
    return (
        of_party(lines, party)
        .filter(last_month("ship_date", as_of))
        .groupBy("party_name")
        .agg(F.count_distinct("order_number").alias("orders"))
    )


def revenue_in_quarter(lines, party, year, quarter):
    start = F.make_date(F.lit(year), F.lit(3 * quarter - 2), F.lit(1))
    shipped = (F.col("ship_date") >= start) & (F.col("ship_date") < F.add_months(start, 3))
    return (
        of_party(lines, party)
        .filter(shipped)
        .groupBy("party_name")
        .agg(S.rounded(F.sum("extended_amount"), 2).alias("revenue"))
    )


def exceptions_by_item(lines: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Exceptions per item. Both sides are folded before they meet, so a purchase order with many
    lines and many exceptions costs one row per item instead of their product."""
    counted = exceptions.groupBy("po_number").agg(F.count(F.lit(1)).alias("_exceptions"))
    items = lines.select(F.col("customer_po_number").alias("po_number"), "item_number").distinct()
    return (
        items.join(counted, "po_number")
        .groupBy("item_number")
        .agg(F.sum("_exceptions").alias("exceptions"))
    )


def item_with_most_exceptions(lines, exceptions):
    return (
        exceptions_by_item(lines, exceptions)
        .orderBy(F.desc("exceptions"), "item_number")
        .limit(1)
    )


# --- products ----------------------------------------------------------------------------------

def family_of_item(products, item):
    return products.filter(F.col("item_number") == F.lit(item)).select("item_number", "product_family")


def active_items(products):
    return count_as(
        products.filter(F.col("lifecycle_phase").isin(config.ACTIVE_PHASES)), "active_items"
    )


def items_in_family(products, family):
    return products.filter(F.col("product_family") == family).select("item_number", "item_name")


# --- shipments ---------------------------------------------------------------------------------

def units_shipped_last_week(outbound, item, as_of):
    return outbound.filter(
        (F.col("item_code") == F.lit(item)) & last_week("shipping_date", as_of)
    ).agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"))


def warranty_orders_this_month(shipments, as_of):
    warranty = F.contains("order_type", F.lit("WARRANTY"))
    return shipments.filter(warranty & this_month("first_ship_date", as_of)).agg(
        F.count_distinct("order_token").alias("warranty_orders")
    )


def ship_cost_last_month(shipments, facility, as_of):
    return (
        shipped_from(shipments, facility)
        .filter(last_month("first_ship_date", as_of))
        .agg(S.rounded(F.sum(F.col("total_std_cost").cast("decimal(18,2)")), 2).alias("total_cost"))
    )
