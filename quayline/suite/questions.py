"""The fixed question suite and the checks on its results."""

from datetime import date

from pyspark.sql import functions as F

from quayline.operators import quality
from quayline.plans import lookup as L, pipelines as P, questions as Q
from quayline.suite import pipelines as C
from quayline.suite.registry import AS_OF, case
from quayline.suite.relational import LATEST_SQL, LOOKUP_SQL, curated

DAY = date(2000, 6, 29)
ORDERS_SQL = f"WITH o AS ({C.DELIVERY_SQL})"
F1 = "LIST_CONTAINS(STRING_SPLIT(facilities, ', '), 'F1')"
THIS_WEEK = "BETWEEN DATE '2000-06-26' AND DATE '2000-06-30'"
LAST_WEEK = "BETWEEN DATE '2000-06-19' AND DATE '2000-06-25'"
LAST_MONTH = "BETWEEN DATE '2000-05-01' AND DATE '2000-05-31'"
THIS_MONTH = "BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'"
ITEM = 17


def orders(t):
    return P.delivery_orders(t.delivery_lines)


BEST_SQL = f"""
    WITH {LOOKUP_SQL},
    best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY requested ORDER BY preference) AS rn FROM lookup)"""


@case("q_order_status", BEST_SQL + " SELECT requested, order_status, source FROM best WHERE rn = 1")
def q_order_status(t):
    found = L.order_lookup(t.order_requests, *curated(t), t.delivery_lines)
    return found.select("requested", "order_status", "source")


LOOKUP_COLUMNS = [
    "requested", "order_number", "source", "found_in", "order_status", "facilities", "carriers",
    "ordered_date", "sent_to_wh_date", "first_ship_date", "last_delivery_date", "unique_skus",
    "total_items", "shipment_count", "tracking_numbers", "shipping_method", "processing_days",
    "transit_days", "state", "city", "shipment_items", "shipment_tracking",
]


@case("q_order_lookup", BEST_SQL + f" SELECT {', '.join(LOOKUP_COLUMNS)} FROM best WHERE rn = 1")
def q_order_lookup(t):
    found = L.order_lookup(t.order_requests, *curated(t), t.delivery_lines)
    return found.select(*LOOKUP_COLUMNS)


@case("q_orders_shipped_facility_day", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS orders_shipped FROM o WHERE {F1} AND first_ship_date = DATE '2000-06-29'""")
def q_orders_shipped_facility_day(t):
    return Q.orders_shipped_on(orders(t), "F1", DAY)


@case("q_orders_shipped_facility_week", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS orders_shipped FROM o WHERE {F1} AND first_ship_date {THIS_WEEK}""")
def q_orders_shipped_facility_week(t):
    return Q.orders_shipped_this_week(orders(t), "F1", AS_OF)


@case("q_orders_shipped_late", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS late_orders FROM o
    WHERE {F1} AND first_ship_date = DATE '2000-06-29' AND processing_days > 2""")
def q_orders_shipped_late(t):
    return Q.orders_shipped_late(orders(t), "F1", DAY)


@case("q_stuck_at_warehouse", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS stuck_orders FROM o WHERE order_status = 'AT_WAREHOUSE'
      AND DATE_DIFF('day', sent_to_wh_date, DATE '2000-06-30') > 3""")
def q_stuck_at_warehouse(t):
    return Q.stuck_at_warehouse(orders(t), AS_OF)


@case("q_avg_transit_last_week", f"""{ORDERS_SQL}
    SELECT CAST(ROUND(CAST(SUM(transit_days) AS DECIMAL(20,8)) / COUNT(transit_days), 2) AS DOUBLE)
           AS avg_transit_days
    FROM o WHERE first_ship_date {LAST_WEEK}""")
def q_avg_transit_last_week(t):
    return Q.avg_transit_last_week(orders(t), AS_OF)


@case("q_top_facility_shipped", f"""{ORDERS_SQL}
    SELECT facility, COUNT(*) AS orders_shipped
    FROM (SELECT UNNEST(STRING_SPLIT(facilities, ', ')) AS facility FROM o
          WHERE first_ship_date = DATE '2000-06-29')
    GROUP BY facility ORDER BY orders_shipped DESC, facility LIMIT 1""")
def q_top_facility_shipped(t):
    return Q.top_facility_shipped(orders(t), DAY)


@case("q_cancelled_last_week", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS cancelled_orders FROM o WHERE order_status = 'CANCELLED' AND ordered_date {LAST_WEEK}""")
def q_cancelled_last_week(t):
    return Q.cancelled_last_week(orders(t), AS_OF)


@case("q_undelivered_7d", f"""{ORDERS_SQL}
    SELECT COUNT(*) AS undelivered_orders FROM o WHERE order_status NOT IN ('DELIVERED', 'CANCELLED')
      AND ordered_date BETWEEN DATE '2000-06-23' AND DATE '2000-06-30'""")
def q_undelivered_7d(t):
    return Q.undelivered(orders(t), AS_OF)


def facility_stock(facility: int) -> str:
    return f"""
    SELECT facility, snapshot_date, CAST(SUM(onhand_quantity) AS BIGINT) AS onhand_quantity
    FROM ({LATEST_SQL}) WHERE facility = {facility} GROUP BY facility, snapshot_date"""


@case("q_inventory_at_facility", facility_stock(3))
def q_inventory_at_facility(t):
    return Q.inventory_at_facility(t.onhand_eod, 3)


@case("q_inventory_other_facility", facility_stock(7))
def q_inventory_other_facility(t):
    return Q.inventory_at_facility(t.onhand_eod, 7)


@case("q_inventory_of_item", f"""
    SELECT CAST(COALESCE(SUM(onhand_quantity), 0) AS BIGINT) AS onhand_quantity
    FROM ({LATEST_SQL}) WHERE item_code = {ITEM}""")
def q_inventory_of_item(t):
    return Q.inventory_of_item(t.onhand_eod, ITEM)


@case("q_top_inventory_facility", f"""
    SELECT facility, CAST(SUM(onhand_quantity) AS BIGINT) AS onhand_quantity FROM ({LATEST_SQL})
    GROUP BY facility ORDER BY onhand_quantity DESC, facility LIMIT 1""")
def q_top_inventory_facility(t):
    return Q.top_inventory_facility(t.onhand_eod)


@case("q_top10_items_inventory", f"""
    SELECT item_code, CAST(SUM(onhand_quantity) AS BIGINT) AS onhand_quantity FROM ({LATEST_SQL})
    WHERE facility = 3 GROUP BY item_code ORDER BY onhand_quantity DESC, item_code LIMIT 10""")
def q_top10_items_inventory(t):
    return Q.top_items_at_facility(t.onhand_eod, 3)


@case("q_inbound_day", f"""
    SELECT sku, item_description, CAST(SUM(avl_quantity) AS BIGINT) AS avl_quantity
    FROM ({C.INBOUND_SQL}) WHERE facility = 'F1' AND inbound_date = '2000-06-29' GROUP BY ALL""")
def q_inbound_day(t):
    return Q.inbound_on(P.all_inbound(t.goods_receipts, t.inbound_other_region), "F1", DAY)


@case("q_inbound_receipts_week", f"""
    SELECT COUNT(*) AS receipts FROM goods_receipts WHERE facility_id = 'F1' AND adjustment_date {THIS_WEEK}""")
def q_inbound_receipts_week(t):
    return Q.inbound_receipts_this_week(t.goods_receipts, "F1", AS_OF)


@case("q_inbound_discrepancies_7d", f"""
    SELECT * FROM ({C.DISCREPANCY_SQL}) WHERE discrepancy_type <> 'MATCH'
      AND doc_date BETWEEN DATE '2000-06-23' AND DATE '2000-06-30'""")
def q_inbound_discrepancies_7d(t):
    found = P.inbound_discrepancies(t.shipped_documents, t.received_documents)
    return Q.recent_discrepancies(found, AS_OF)


def customer_units(name: str) -> str:
    return f"""
    SELECT party_name, CAST(SUM(shipped_quantity) AS BIGINT) AS units FROM retail_order_lines
    WHERE party_name LIKE '%{name}%' AND item_number = {ITEM}
      AND ship_date >= DATE '1998-01-01' AND ship_date < DATE '1998-02-01' GROUP BY party_name"""


MONTH = (date(1998, 1, 1), date(1998, 2, 1))


@case("q_units_customer_month", customer_units("Building Stores"))
def q_units_customer_month(t):
    return Q.units_to_customer(t.retail_order_lines, ITEM, "Building Stores", *MONTH)


@case("q_units_customer_month_b", customer_units("Fulfillment Services"))
def q_units_customer_month_b(t):
    return Q.units_to_customer(t.retail_order_lines, ITEM, "Fulfillment Services", *MONTH)


@case("q_price_item_customer", f"""
    SELECT DISTINCT party_name, CAST(unit_selling_price AS DOUBLE) AS unit_selling_price
    FROM retail_order_lines WHERE party_name LIKE '%Purchasing%' AND item_number = {ITEM}""")
def q_price_item_customer(t):
    return Q.price_of_item(t.retail_order_lines, ITEM, "Purchasing")


@case("q_open_orders_customer", """
    SELECT order_number, customer_po_number, party_name, CAST(SUM(ordered_qty) AS BIGINT) AS ordered_qty,
           CAST(SUM(shipped_quantity) AS BIGINT) AS shipped_quantity
    FROM retail_order_lines WHERE party_name LIKE '%Supply%' AND status_code NOT IN ('CLOSED', 'CANCELLED')
    GROUP BY ALL""")
def q_open_orders_customer(t):
    return Q.open_orders(t.retail_order_lines, "Supply")


@case("q_exceptions_week", f"""
    SELECT error_category, COUNT(*) AS exceptions FROM retail_order_exceptions
    WHERE ordered_date {THIS_WEEK} GROUP BY error_category""")
def q_exceptions_week(t):
    return Q.exceptions_this_week(t.retail_order_exceptions, AS_OF)


@case("q_orders_customer_last_month", f"""
    SELECT party_name, COUNT(DISTINCT order_number) AS orders FROM retail_order_lines
    WHERE party_name LIKE '%Purchasing%' AND ship_date {LAST_MONTH} GROUP BY party_name""")
def q_orders_customer_last_month(t):
    return Q.customer_orders_last_month(t.retail_order_lines, "Purchasing", AS_OF)


@case("q_revenue_customer_quarter", """
    SELECT party_name, CAST(SUM(extended_amount) AS DOUBLE) AS revenue FROM retail_order_lines
    WHERE party_name LIKE '%Fulfillment%' AND ship_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'
    GROUP BY party_name""")
def q_revenue_customer_quarter(t):
    return Q.revenue_in_quarter(t.retail_order_lines, "Fulfillment", 2000, 1)


@case("q_item_most_exceptions", """
    SELECT s.item_number, COUNT(DISTINCT e.exception_id) AS exceptions
    FROM retail_order_exceptions e JOIN retail_order_lines s ON s.customer_po_number = e.po_number
    GROUP BY s.item_number ORDER BY exceptions DESC, s.item_number LIMIT 1""")
def q_item_most_exceptions(t):
    return Q.item_with_most_exceptions(t.retail_order_lines, t.retail_order_exceptions)


@case("q_product_family", f"SELECT item_number, product_family FROM item_dimension WHERE item_number = {ITEM}")
def q_product_family(t):
    return Q.family_of_item(t.item_dimension, ITEM)


@case("q_active_items", """
    SELECT COUNT(*) AS active_items FROM item_dimension WHERE lifecycle_phase IN ('Released', 'In Production')""")
def q_active_items(t):
    return Q.active_items(t.item_dimension)


@case("q_items_in_family", "SELECT item_number, item_name FROM item_dimension WHERE product_family = 'PROMO'")
def q_items_in_family(t):
    return Q.items_in_family(t.item_dimension, "PROMO")


@case("q_units_item_last_week", f"""
    SELECT CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS units FROM outbound_lines
    WHERE item_code = {ITEM} AND shipping_date {LAST_WEEK}""")
def q_units_item_last_week(t):
    return Q.units_shipped_last_week(t.outbound_lines, ITEM, AS_OF)


@case("q_warranty_orders_month", f"""
    SELECT COUNT(DISTINCT order_token) AS warranty_orders FROM ({C.SHIPMENTS_SQL})
    WHERE contains(order_type, 'WARRANTY') AND first_ship_date {THIS_MONTH}""")
def q_warranty_orders_month(t):
    return Q.warranty_orders_this_month(P.shipments(t.outbound_lines, AS_OF), AS_OF)


@case("q_ship_cost_facility_month", f"""
    SELECT CAST(SUM(CAST(total_std_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM ({C.SHIPMENTS_SQL})
    WHERE {F1} AND first_ship_date {LAST_MONTH}""")
def q_ship_cost_facility_month(t):
    return Q.ship_cost_last_month(P.shipments(t.outbound_lines, AS_OF), "F1", AS_OF)


# --- result checks -----------------------------------------------------------------------------

CHECKED = {
    "receipts": ("inbound", lambda t: t.goods_receipts.select("item_code")),
    "nowhere": ("inbound", lambda t: t.goods_receipts.filter("facility_id = 'none'")),
    "no_units": ("shipments", lambda t: t.outbound_lines.filter("item_code < 0").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"))),
    "no_date": ("shipments", lambda t: t.outbound_lines.filter("item_code < 0").agg(
        F.max("shipping_date").alias("latest"))),
    "units": ("shipments", lambda t: t.outbound_lines.agg(F.sum("quantity").alias("units"))),
    "unknown_column": ("inbound", lambda t: t.goods_receipts.select("no_such_column")),
}
CHECKED_SQL = """
    SELECT 'receipts' AS name, 'inbound' AS category, (SELECT COUNT(*) FROM goods_receipts) AS row_count, 'OK' AS status
    UNION ALL SELECT 'nowhere', 'inbound', 0, 'ZERO_ROWS'
    UNION ALL SELECT 'no_units', 'shipments', 1, 'SUSPICIOUS_ZERO'
    UNION ALL SELECT 'no_date', 'shipments', 1, 'SUSPICIOUS_ZERO'
    UNION ALL SELECT 'units', 'shipments', 1, 'OK'
    UNION ALL SELECT 'unknown_column', 'inbound', 0, 'ERROR'"""


def results(t):
    checks = {n: (category, lambda b=build: b(t)) for n, (category, build) in CHECKED.items()}
    return quality.check_results(t.spark, checks)


@case("check_result_status", CHECKED_SQL)
def check_result_status(t):
    return results(t).drop("error")


@case("check_summary", f"SELECT category, status, COUNT(*) AS queries FROM ({CHECKED_SQL}) GROUP BY ALL")
def check_summary(t):
    return quality.check_summary(results(t))


@case("dup_factor", """
    SELECT COUNT(item_number) AS row_count, COUNT(DISTINCT item_number) AS key_count,
           ROUND(CAST(COUNT(item_number) AS DOUBLE) / COUNT(DISTINCT item_number), 4) AS dup_factor
    FROM product_revisions""")
def dup_factor(t):
    return quality.dup_factor(t.product_revisions, "item_number")


@case("fanout_guard", """
    SELECT item_number, COUNT(*) AS copies FROM product_revisions GROUP BY item_number HAVING COUNT(*) > 1""")
def fanout_guard(t):
    return quality.fanout_guard(t.product_revisions, "item_number")
