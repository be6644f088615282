"""Curated tables."""

from pyspark.sql import functions as F

from quayline import config
from quayline.plans import pipelines as P
from quayline.suite.registry import AS_OF, case

DELIVERY_SQL = """
    SELECT order_number, MAX(source_order_number) AS source_order_number,
           MAX(customer_name) AS customer_name, MAX(country) AS country, MAX(state) AS state,
           MAX(city) AS city,
           STRING_AGG(DISTINCT facility, ', ' ORDER BY facility) AS facilities,
           STRING_AGG(DISTINCT carrier_code, ', ' ORDER BY carrier_code) AS carriers,
           MAX(shipping_method) AS shipping_method, MAX(order_type) AS order_type,
           MAX(is_split_order) AS is_split_order,
           MIN(ordered_date) AS ordered_date, MIN(sent_to_warehouse_date) AS sent_to_wh_date,
           MIN(shipped_date) AS first_ship_date, MAX(shipped_date) AS last_ship_date,
           MIN(delivery_date) AS first_delivery_date, MAX(delivery_date) AS last_delivery_date,
           MAX(estimated_delivery_date) AS estimated_delivery_date,
           COUNT(DISTINCT item_name) AS unique_skus,
           CAST(SUM(quantity) AS BIGINT) AS total_items,
           COUNT(DISTINCT tracking_number) AS shipment_count,
           STRING_AGG(DISTINCT tracking_number, ', ' ORDER BY tracking_number) AS tracking_numbers,
           MAX(delivery_status) AS delivery_status,
           CASE WHEN MAX(cancelled_flag) = 'Y' THEN 'CANCELLED'
                WHEN MIN(CASE WHEN is_delivered THEN 1 ELSE 0 END) = 1 THEN 'DELIVERED'
                WHEN MAX(CASE WHEN is_delivered THEN 1 ELSE 0 END) = 1 THEN 'PARTIALLY_DELIVERED'
                WHEN MAX(shipped_date) IS NOT NULL THEN 'SHIPPED'
                WHEN MAX(sent_to_warehouse_date) IS NOT NULL THEN 'AT_WAREHOUSE'
                ELSE 'ORDERED' END AS order_status,
           MAX(processing_days) AS processing_days, MAX(transit_days) AS transit_days,
           MAX(days_to_delivery) AS days_to_delivery
    FROM delivery_lines GROUP BY order_number"""


def delivery_sql(source: str) -> str:
    """The roll-up over another source of lines."""
    return DELIVERY_SQL.replace("FROM delivery_lines", f"FROM {source}")


SHIPMENTS_SQL = """
    SELECT order_token, order_number AS internal_order_number,
           MAX(order_type_code) AS order_type, MAX(order_type_name) AS order_type_name,
           MAX(eff_order_type) AS eff_order_type, MAX(sales_channel) AS sales_channel,
           MAX(country) AS country, MAX(ship_to_name) AS ship_to_name,
           STRING_AGG(DISTINCT facility_id, ', ' ORDER BY facility_id) AS facilities,
           STRING_AGG(DISTINCT carrier_code, ', ' ORDER BY carrier_code) AS carriers,
           MAX(ship_method) AS ship_method, MIN(shipping_date) AS first_ship_date,
           MAX(shipping_date) AS last_ship_date, COUNT(DISTINCT item_code) AS unique_skus,
           CAST(SUM(quantity) AS BIGINT) AS total_items,
           COUNT(DISTINCT tracking_number) AS shipment_count,
           STRING_AGG(DISTINCT tracking_number, ', ' ORDER BY tracking_number) AS tracking_numbers,
           CAST(SUM(number_packages) AS BIGINT) AS total_packages,
           CAST(SUM(std_cost) AS DOUBLE) AS total_std_cost,
           COUNT(DISTINCT serial_number) AS serial_count, MAX(client_code) AS client_code,
           MAX(product_name) AS product_name, MAX(process_flag) AS process_flag,
           MAX(is_expedited) AS is_expedited
    FROM outbound_lines WHERE shipping_date >= DATE '2000-06-30' - INTERVAL 2 YEAR
    GROUP BY order_token, order_number"""

PRODUCTS_SQL = """
    SELECT r.id AS product_id, r.item_number, r.item_name, r.item_category, r.lifecycle_phase,
           r.revision, r.product_family, r.updated_at, p.product_category,
           p.serialized_item AS pkg_serialized_item, p.units_per_master_carton,
           p.units_per_ocean_pallet
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_number
                    ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn
          FROM product_revisions WHERE item_number IS NOT NULL) r
    LEFT JOIN packaging_versions p ON p.sku = r.item_number AND p.valid_to IS NULL
    WHERE r.rn = 1"""

TENANTS = ["T1"]
FACILITIES = ["F0", "F1", "F2"]
RECEIPTS_SQL = """
    SELECT strftime(adjustment_date, '%Y-%m-%d') AS adjustment_date, facility_id, item_code,
           item_description, product_name, client_code, adjustment_id,
           COALESCE(avl_quantity, 0) AS avl_quantity, COALESCE(unavl_quantity, 0) AS unavl_quantity,
           COALESCE(return_quantity, 0) AS return_quantity,
           CAST(COALESCE(std_cost, 0) AS DOUBLE) AS std_cost,
           CAST(COALESCE(extended_cost, 0) AS DOUBLE) AS extended_cost, file_name, process_flag
    FROM receipts_source
    WHERE tenant IN ('T1') AND facility_id IN ('F0', 'F1', 'F2') AND remarks = 'STAT'"""


def costs_as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in config.RECEIPT_AMOUNTS})


@case("delivery_orders", DELIVERY_SQL)
def delivery_orders(t):
    return P.delivery_orders(t.delivery_lines)


@case("shipments", SHIPMENTS_SQL)
def shipments(t):
    return P.shipments(t.outbound_lines, AS_OF)


@case("products_current", PRODUCTS_SQL)
def products_current(t):
    return P.products_current(t.product_revisions, t.packaging_versions)


@case("po_lines", "SELECT * FROM po_details")
def po_lines(t):
    return P.po_lines(t.po_details)


@case("inventory_eod", f"""
    WITH products AS ({PRODUCTS_SQL})
    SELECT o.*, p.product_family, p.item_name AS product_name, p.lifecycle_phase, p.product_category
    FROM onhand_eod o LEFT JOIN products p ON p.item_number = o.item_code
    WHERE o.snapshot_date >= DATE '2000-06-30' - 90""")
def inventory_eod(t):
    return P.inventory_eod(t.onhand_eod, products_current(t), AS_OF)


@case("goods_receipts", RECEIPTS_SQL)
def goods_receipts(t):
    return costs_as_double(P.goods_receipts(t.receipts_source, TENANTS, FACILITIES))


@case("goods_receipts_lookback", RECEIPTS_SQL + " AND adjustment_date >= DATE '2000-06-30' - 30")
def goods_receipts_lookback(t):
    return costs_as_double(P.goods_receipts(
        t.receipts_source, TENANTS, FACILITIES, as_of=AS_OF, lookback_days=30
    ))


@case("receipts_7d", """
    SELECT strftime(adjustment_date, '%Y-%m-%d') AS adjustment_date, facility_id, item_code,
           item_description, product_name,
           CAST(COALESCE(SUM(avl_quantity), 0) AS BIGINT) AS avl_quantity,
           CAST(COALESCE(SUM(unavl_quantity), 0) AS BIGINT) AS unavl_quantity
    FROM goods_receipts
    WHERE adjustment_date >= DATE '2000-06-24' AND adjustment_date < DATE '2000-07-01'
    GROUP BY ALL""")
def receipts_7d(t):
    return P.receipts_7d(t.goods_receipts, AS_OF)


INBOUND_SQL = """
    SELECT strftime(adjustment_date, '%Y-%m-%d') AS inbound_date, facility_id AS facility,
           item_code AS sku, item_description, 'NA' AS region, avl_quantity,
           CAST(NULL AS BIGINT) AS received_quantity
    FROM goods_receipts
    UNION ALL
    SELECT strftime(arrival_date, '%Y-%m-%d'), facility, sku, NULL, region, NULL,
           received_quantity
    FROM inbound_other_region"""


@case("all_inbound", INBOUND_SQL)
def all_inbound(t):
    return P.all_inbound(t.goods_receipts, t.inbound_other_region)


DISCREPANCY_SQL = """
    SELECT COALESCE(s.doc_date, r.doc_date) AS doc_date, COALESCE(s.item_code, r.item_code) AS item_code,
           s.qty AS shipped_qty, r.qty AS received_qty,
           COALESCE(r.qty, 0) - COALESCE(s.qty, 0) AS variance,
           CASE WHEN s.qty IS NULL THEN 'NOT_SHIPPED' WHEN r.qty IS NULL THEN 'NOT_RECEIVED'
                WHEN r.qty < s.qty THEN 'SHORT' WHEN r.qty > s.qty THEN 'OVER' ELSE 'MATCH' END
               AS discrepancy_type
    FROM (SELECT doc_date, item_code, CAST(SUM(quantity) AS BIGINT) AS qty
          FROM shipped_documents GROUP BY 1, 2) s
    FULL JOIN (SELECT doc_date, item_code, CAST(SUM(quantity) AS BIGINT) AS qty
               FROM received_documents GROUP BY 1, 2) r
      ON r.doc_date = s.doc_date AND r.item_code = s.item_code"""


@case("inbound_discrepancies", DISCREPANCY_SQL)
def inbound_discrepancies(t):
    return P.inbound_discrepancies(t.shipped_documents, t.received_documents)


MONTHS_SQL = """(YEAR(snapshot_date) - YEAR(receive_date)) * 12
           + MONTH(snapshot_date) - MONTH(receive_date)
           + CASE WHEN DAY(snapshot_date) = DAY(receive_date)
                    OR (snapshot_date = LAST_DAY(snapshot_date) AND receive_date = LAST_DAY(receive_date))
                  THEN 0 ELSE (DAY(snapshot_date) - DAY(receive_date)) / 31.0 END"""


@case("inventory_aging", f"""
    SELECT product_number, product_type, warehouse, status, receive_date, snapshot_date, quantity,
           CAST(unit_cost_usd AS DOUBLE) AS unit_cost_usd,
           CAST(ROUND(m, 2) AS DOUBLE) AS age_months,
           CASE WHEN product_type = '1P' THEN CASE WHEN m <= 3 THEN '0-3 months' WHEN m <= 6 THEN '3-6 months'
                     WHEN m <= 12 THEN '6-12 months' ELSE '>12 months' END
                WHEN product_type = '3P' THEN CASE WHEN m <= 5 THEN '0-5 months' WHEN m <= 8 THEN '5-8 months'
                     WHEN m <= 12 THEN '8-12 months' ELSE '>12 months' END
                ELSE 'Unknown' END AS age_band,
           CASE WHEN product_type = '1P' THEN CASE WHEN m <= 3 THEN 'Target' WHEN m <= 6 THEN 'Low Risk'
                     WHEN m <= 12 THEN 'Medium Risk' ELSE 'High Risk' END
                WHEN product_type = '3P' THEN CASE WHEN m <= 5 THEN 'Target' WHEN m <= 8 THEN 'Low Risk'
                     WHEN m <= 12 THEN 'Medium Risk' ELSE 'High Risk' END
                ELSE 'Unknown' END AS risk_category,
           CAST(quantity * unit_cost_usd AS DOUBLE) AS onhand_value_usd
    FROM (SELECT *, CAST({MONTHS_SQL} AS DOUBLE) AS m FROM stock_lots)""")
def inventory_aging(t):
    return P.inventory_aging(t.stock_lots).withColumn(
        "unit_cost_usd", F.col("unit_cost_usd").cast("double")
    )


@case("partner_onhand", """
    SELECT l_partkey AS sku, l_suppkey AS location,
           CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS avl,
           CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total
    FROM lineitem GROUP BY 1, 2""")
def partner_onhand(t):
    quantity = F.col("l_quantity").cast("bigint")
    return P.partner_onhand(t.lineitem.select(
        F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("location"),
        F.when(F.col("l_linestatus") == "F", quantity).otherwise(0).alias("available"),
        quantity.alias("total"),
    ))
