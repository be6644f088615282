"""Filters, joins, aggregations, windows, ordering and set operations."""

from pyspark.sql import functions as F

from quayline import config
from quayline.functions import scalars as S
from quayline.operators import distinct as D, relational as R
from quayline.operators.triage import mix
from quayline.plans import lookup as L, pipelines as P, questions as Q
from quayline.session import scratch_path
from quayline.sources import files
from quayline.streaming import messages as B
from quayline.suite import pipelines as C
from quayline.suite.registry import AS_OF, case

# --- projections and filters -------------------------------------------------------------------


@case("project_rename", """
    SELECT facility_id AS facility, item_code AS sku, adjustment_id AS receipt_id FROM receipts_source""")
def project_rename(t):
    return t.receipts_source.select(
        F.col("facility_id").alias("facility"), F.col("item_code").alias("sku"),
        F.col("adjustment_id").alias("receipt_id"),
    )


@case("filter_in_list", """
    SELECT adjustment_id, facility_id, tenant FROM receipts_source
    WHERE tenant IN ('T1', 'T2') AND facility_id IN ('F0', 'F2') AND remarks = 'STAT'""")
def filter_in_list(t):
    return t.receipts_source.filter(
        F.col("tenant").isin("T1", "T2") & F.col("facility_id").isin("F0", "F2")
        & (F.col("remarks") == "STAT")
    ).select("adjustment_id", "facility_id", "tenant")


@case("filter_rolling_days", """
    SELECT adjustment_date, facility_id, item_code FROM goods_receipts
    WHERE adjustment_date BETWEEN DATE '2000-06-30' - 90 AND DATE '2000-06-30'""")
def filter_rolling_days(t):
    return t.goods_receipts.filter(R.since("adjustment_date", AS_OF, 90)).select(
        "adjustment_date", "facility_id", "item_code"
    )


@case("filter_half_open_week", """
    SELECT adjustment_date, facility_id, item_code FROM goods_receipts
    WHERE adjustment_date >= DATE '2000-06-24' AND adjustment_date < DATE '2000-07-01'""")
def filter_half_open_week(t):
    return t.goods_receipts.filter(R.half_open_days("adjustment_date", AS_OF, 7)).select(
        "adjustment_date", "facility_id", "item_code"
    )


@case("filter_optional_param", """
    SELECT facility_id, item_code, avl_quantity, 'all' AS asked FROM goods_receipts
    UNION ALL
    SELECT facility_id, item_code, avl_quantity, 'one' FROM goods_receipts WHERE facility_id = 'F1'""")
def filter_optional_param(t):
    rows = t.goods_receipts.select("facility_id", "item_code", "avl_quantity")
    everything = R.optional_equals(rows, "facility_id", None).withColumn("asked", F.lit("all"))
    one = R.optional_equals(rows, "facility_id", "F1").withColumn("asked", F.lit("one"))
    return everything.unionByName(one)


@case("filter_not_blank", """
    SELECT item_code, product_name FROM goods_receipts
    WHERE product_name IS NOT NULL AND product_name <> ''""")
def filter_not_blank(t):
    return t.goods_receipts.filter(R.not_blank("product_name")).select("item_code", "product_name")


@case("filter_like_contains", """
    SELECT order_number, party_name FROM retail_order_lines WHERE party_name LIKE '%Purchasing%'""")
def filter_like_contains(t):
    return Q.of_party(t.retail_order_lines, "Purchasing").select("order_number", "party_name")


@case("filter_like_prefix", "SELECT item_number, item_name FROM item_dimension WHERE item_name LIKE 'red%'")
def filter_like_prefix(t):
    return t.item_dimension.filter(F.col("item_name").startswith("red")).select(
        "item_number", "item_name"
    )


@case("filter_not_in_status", """
    SELECT order_number, status_code FROM retail_order_lines
    WHERE status_code NOT IN ('CLOSED', 'CANCELLED')""")
def filter_not_in_status(t):
    return t.retail_order_lines.filter(~F.col("status_code").isin("CLOSED", "CANCELLED")).select(
        "order_number", "status_code"
    )


@case("filter_text_date", """
    SELECT inbound_date, facility, sku FROM (
        SELECT strftime(arrival_date, '%Y-%m-%d') AS inbound_date, facility, sku FROM inbound_other_region)
    WHERE CAST(inbound_date AS DATE) >= DATE '2000-05-31'""")
def filter_text_date(t):
    feed = t.inbound_other_region.select(
        S.date_text(F.col("arrival_date")).alias("inbound_date"), "facility", "sku"
    )
    return feed.filter(F.to_date("inbound_date") >= F.date_sub(S.as_date(AS_OF), 30))


@case("filter_active_items", """
    SELECT item_number, lifecycle_phase FROM item_dimension
    WHERE lifecycle_phase IN ('Released', 'In Production')""")
def filter_active_items(t):
    return t.item_dimension.filter(F.col("lifecycle_phase").isin(config.ACTIVE_PHASES)).select(
        "item_number", "lifecycle_phase"
    )


@case("filter_current_version", "SELECT sku, version_id FROM packaging_versions WHERE valid_to IS NULL")
def filter_current_version(t):
    return t.packaging_versions.filter(F.col("valid_to").isNull()).select("sku", "version_id")


# --- joins -------------------------------------------------------------------------------------


@case("join_left_scd2", """
    SELECT r.id, r.item_number, p.version_id, p.product_category
    FROM product_revisions r LEFT JOIN packaging_versions p
      ON p.sku = r.item_number AND p.valid_to IS NULL""")
def join_left_scd2(t):
    current = t.packaging_versions.filter(F.col("valid_to").isNull())
    revisions = t.product_revisions
    return revisions.join(current, revisions.item_number == current.sku, "left").select(
        "id", "item_number", "version_id", "product_category"
    )


@case("join_left_dimension", """
    SELECT g.adjustment_id, g.item_code, d.product_family, d.lifecycle_phase
    FROM goods_receipts g LEFT JOIN item_dimension d ON d.item_number = g.item_code""")
def join_left_dimension(t):
    receipts, items = t.goods_receipts, t.item_dimension
    return receipts.join(items, receipts.item_code == items.item_number, "left").select(
        "adjustment_id", "item_code", "product_family", "lifecycle_phase"
    )


EXCEPTIONS_SQL = """
    SELECT s.item_number, COUNT(DISTINCT e.exception_id) AS exceptions
    FROM retail_order_exceptions e JOIN retail_order_lines s ON s.customer_po_number = e.po_number
    GROUP BY s.item_number"""


@case("join_inner_exceptions", EXCEPTIONS_SQL)
def join_inner_exceptions(t):
    return Q.exceptions_by_item(t.retail_order_lines, t.retail_order_exceptions)


def tokens_sql(shipments: str) -> str:
    """Shipments folded to order tokens, with the lists over the lines of the shipments kept."""
    return f"""
    SELECT s.order_token, MAX(s.order_type) AS shipment_order_type,
           MIN(s.first_ship_date) AS shipment_first_ship_date,
           CAST(SUM(s.total_items) AS BIGINT) AS shipment_items,
           CAST(SUM(CAST(s.total_std_cost AS DECIMAL(18,2))) AS DOUBLE) AS shipment_cost,
           MAX(x.facilities) AS shipment_facilities, MAX(x.carriers) AS shipment_carriers,
           MAX(x.tracking) AS shipment_tracking
    FROM ({shipments}) s
    JOIN (SELECT l.order_token,
                 STRING_AGG(DISTINCT l.facility_id, ', ' ORDER BY l.facility_id) AS facilities,
                 STRING_AGG(DISTINCT l.carrier_code, ', ' ORDER BY l.carrier_code) AS carriers,
                 STRING_AGG(DISTINCT l.tracking_number, ', ' ORDER BY l.tracking_number) AS tracking
          FROM outbound_lines l JOIN ({shipments}) k
            ON k.order_token = l.order_token AND k.internal_order_number = l.order_number
          WHERE l.shipping_date >= DATE '2000-06-30' - INTERVAL 2 YEAR
          GROUP BY l.order_token) x ON x.order_token = s.order_token
    GROUP BY s.order_token"""


def order_shipment_sql(orders: str, shipments: str) -> str:
    return f"""
    SELECT o.* EXCLUDE (order_number), t.* EXCLUDE (order_token),
           COALESCE(o.order_number, t.order_token) AS order_number,
           CASE WHEN t.order_token IS NULL THEN 'delivery' WHEN o.order_number IS NULL THEN 'shipment'
                ELSE 'both' END AS found_in
    FROM ({orders}) o
    FULL JOIN ({tokens_sql(shipments)}) t ON t.order_token = o.order_number"""


CURATED_ORDERS_SQL = f"""
    SELECT * FROM ({C.DELIVERY_SQL}) WHERE ordered_date <= DATE '2000-06-30' AND order_number NOT LIKE 'GB-%'"""
CURATED_SHIPMENTS_SQL = f"SELECT * FROM ({C.SHIPMENTS_SQL}) WHERE first_ship_date <= DATE '2000-06-30'"
CURATED_SQL = order_shipment_sql(CURATED_ORDERS_SQL, CURATED_SHIPMENTS_SQL)


def curated(t):
    """The curated tables as of the last refresh: later orders are missing as a whole.

    Orders of one country reach us as shipments only.
    """
    today = S.as_date(AS_OF)
    orders = P.delivery_orders(t.delivery_lines).filter(
        (F.col("ordered_date") <= today) & ~F.col("order_number").startswith("GB-")
    )
    return orders, P.shipments(t.outbound_lines, AS_OF).filter(F.col("first_ship_date") <= today)


@case("join_order_shipment", order_shipment_sql(C.DELIVERY_SQL, C.SHIPMENTS_SQL))
def join_order_shipment(t):
    joined = L.order_shipment(P.delivery_orders(t.delivery_lines), P.shipments(t.outbound_lines, AS_OF))
    return joined.withColumn("shipment_cost", S.rounded(F.col("shipment_cost"), 2))


LOOKUP_SQL = f"""
    requests AS (SELECT DISTINCT UPPER(order_number) AS requested FROM order_requests),
    candidates AS (
        SELECT requested, requested AS order_number, 0 AS preference FROM requests
        UNION ALL
        SELECT requested, LEFT(requested, LENGTH(requested) - 3), 1 FROM requests
        WHERE requested LIKE '%-WR'),
    known AS ({CURATED_SQL}),
    hits AS (SELECT c.requested, c.preference, 'curated' AS source, k.*
             FROM candidates c JOIN known k ON k.order_number = c.order_number),
    recovered AS (
        SELECT c.requested, c.preference, 'lines' AS source, o.*, 'delivery' AS found_in
        FROM candidates c JOIN ({C.DELIVERY_SQL}) o ON o.order_number = c.order_number
        WHERE c.requested NOT IN (SELECT requested FROM hits)),
    lookup AS (SELECT * FROM hits UNION ALL BY NAME SELECT * FROM recovered)"""


@case("lookup_fallback", f"""
    WITH {LOOKUP_SQL}
    SELECT requested, preference, order_number, source, found_in, order_status, total_items,
           tracking_numbers, shipment_items FROM lookup""")
def lookup_fallback(t):
    hits = L.lookup_fallback(t.order_requests, *curated(t), t.delivery_lines)
    return hits.select(
        "requested", "preference", "order_number", "source", "found_in", "order_status",
        "total_items", "tracking_numbers", "shipment_items",
    )


LATEST_SQL = """
    SELECT id, facility, snapshot_date, item_code, onhand_quantity FROM onhand_eod o
    WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM onhand_eod m WHERE m.facility = o.facility)"""


@case("join_latest_snapshot", LATEST_SQL)
def join_latest_snapshot(t):
    return R.at_latest_per_group(t.onhand_eod, "facility", "snapshot_date").select(
        "id", "facility", "snapshot_date", "item_code", "onhand_quantity"
    )


ALIASES = {"Compact": ["SMALL", "MEDIUM"], "Bulk": ["LARGE"], "Budget": ["ECONOMY", "SMALL"]}


@case("join_alias_expand", """
    WITH aliases(alias, code) AS (VALUES ('Compact', 'SMALL'), ('Compact', 'MEDIUM'), ('Bulk', 'LARGE'),
                                         ('Budget', 'ECONOMY'), ('Budget', 'SMALL'))
    SELECT a.alias, d.product_family, d.item_number
    FROM item_dimension d JOIN aliases a ON a.code = d.product_family""")
def join_alias_expand(t):
    return R.expand_aliases(t.item_dimension, "product_family", ALIASES).select(
        "alias", "product_family", "item_number"
    )


@case("anti_answered", """
    SELECT thread_id, turn, author FROM thread_messages m
    WHERE turn = 0 AND NOT EXISTS (SELECT 1 FROM thread_messages r
                                   WHERE r.thread_id = m.thread_id AND r.author = 'BOT')""")
def anti_answered(t):
    parents = t.thread_messages.filter("turn = 0")
    return B.without_answer(parents, t.thread_messages, "BOT").select("thread_id", "turn", "author")


LATER_REPLY_SQL = """
    SELECT thread_id, turn, author FROM thread_messages m
    WHERE turn > 0 AND author <> 'BOT' AND contains(body, '<@BOT>')
      AND NOT EXISTS (SELECT 1 FROM thread_messages r WHERE r.thread_id = m.thread_id
                      AND r.author = 'BOT' AND r.turn > m.turn)"""


@case("anti_later_reply", LATER_REPLY_SQL)
def anti_later_reply(t):
    return B.unanswered_mentions(t.thread_messages, "BOT").select("thread_id", "turn", "author")


@case("scalar_subqueries", """
    SELECT (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(*) FROM customer) AS customers,
           (SELECT MAX(l_shipdate) FROM lineitem) AS last_ship,
           (SELECT COUNT(DISTINCT p_type) FROM part) AS families""")
def scalar_subqueries(t):
    customers = t.customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    last_ship = t.lineitem.agg(F.max("l_shipdate").alias("d")).scalar()
    families = t.part.agg(F.count_distinct("p_type").alias("n")).scalar()
    return (
        t.orders.agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("customers", customers)
        .withColumn("last_ship", last_ship)
        .withColumn("families", families)
    )


# --- aggregations ------------------------------------------------------------------------------


@case("agg_sum_count_minmax", """
    SELECT facility, COUNT(*) AS lines, CAST(SUM(quantity) AS BIGINT) AS quantity,
           MIN(line_date) AS first_line, MAX(line_date) AS last_line
    FROM delivery_lines GROUP BY facility""")
def agg_sum_count_minmax(t):
    return t.delivery_lines.groupBy("facility").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"),
        F.min("line_date").alias("first_line"), F.max("line_date").alias("last_line"),
    )


@case("agg_multi_distinct", """
    SELECT facility, COUNT(DISTINCT item_name) AS items, COUNT(DISTINCT tracking_number) AS parcels,
           COUNT(DISTINCT order_number) AS orders
    FROM delivery_lines GROUP BY facility""")
def agg_multi_distinct(t):
    return t.delivery_lines.groupBy("facility").agg(
        F.count_distinct("item_name").alias("items"),
        F.count_distinct("tracking_number").alias("parcels"),
        F.count_distinct("order_number").alias("orders"),
    )


@case("agg_distinct_levels", """
    SELECT 'both' AS level, facility, carrier_code, COUNT(DISTINCT item_name) AS items, COUNT(DISTINCT order_number) AS orders
    FROM delivery_lines GROUP BY facility, carrier_code
    UNION ALL SELECT 'facility', facility, NULL, COUNT(DISTINCT item_name), COUNT(DISTINCT order_number)
    FROM delivery_lines GROUP BY facility
    UNION ALL SELECT 'carrier', NULL, carrier_code, COUNT(DISTINCT item_name), COUNT(DISTINCT order_number)
    FROM delivery_lines GROUP BY carrier_code
    UNION ALL SELECT 'all', NULL, NULL, COUNT(DISTINCT item_name), COUNT(DISTINCT order_number) FROM delivery_lines""")
def agg_distinct_levels(t):
    """Distinct items and orders at four levels, all from one pass over the lines."""
    return D.distinct_levels(
        t.delivery_lines, {"both": ["facility", "carrier_code"], "facility": ["facility"], "carrier": ["carrier_code"], "all": []},
        {"items": "item_name", "orders": "order_number"},
    )


@case("agg_distinct_list", """
    SELECT order_number, STRING_AGG(DISTINCT facility, ', ' ORDER BY facility) AS facility,
           STRING_AGG(DISTINCT carrier_code, ', ' ORDER BY carrier_code) AS carrier_code
    FROM delivery_lines GROUP BY order_number""")
def agg_distinct_list(t):
    return R.distinct_lists(t.delivery_lines, ["order_number"], ["facility", "carrier_code"])


@case("agg_status_case", f"SELECT order_number, order_status FROM ({C.DELIVERY_SQL})")
def agg_status_case(t):
    return P.delivery_orders(t.delivery_lines).select("order_number", "order_status")


@case("agg_all_any_bool", """
    SELECT order_number, MIN(CASE WHEN is_delivered THEN 1 ELSE 0 END) = 1 AS all_delivered,
           MAX(CASE WHEN is_delivered THEN 1 ELSE 0 END) = 1 AS any_delivered
    FROM delivery_lines GROUP BY order_number""")
def agg_all_any_bool(t):
    delivered = F.coalesce("is_delivered", F.lit(False))
    return t.delivery_lines.groupBy("order_number").agg(
        F.bool_and(delivered).alias("all_delivered"), F.bool_or(delivered).alias("any_delivered")
    )


@case("agg_arbitrary_attr", """
    SELECT order_number, MAX(country) AS country, MAX(state) AS state, MAX(shipping_method) AS shipping_method
    FROM delivery_lines GROUP BY order_number""")
def agg_arbitrary_attr(t):
    attributes = ["country", "state", "shipping_method"]
    return t.delivery_lines.groupBy("order_number").agg(*[F.max(c).alias(c) for c in attributes])


@case("agg_lifecycle_dates", """
    SELECT order_number, MIN(ordered_date) AS ordered, MIN(shipped_date) AS first_ship,
           MAX(shipped_date) AS last_ship, MIN(delivery_date) AS first_delivery,
           MAX(delivery_date) AS last_delivery
    FROM delivery_lines GROUP BY order_number""")
def agg_lifecycle_dates(t):
    return t.delivery_lines.groupBy("order_number").agg(
        F.min("ordered_date").cast("date").alias("ordered"),
        F.min("shipped_date").cast("date").alias("first_ship"),
        F.max("shipped_date").cast("date").alias("last_ship"),
        F.min("delivery_date").cast("date").alias("first_delivery"),
        F.max("delivery_date").cast("date").alias("last_delivery"),
    )


@case("agg_global", """
    SELECT COUNT(*) AS total, MIN(adjustment_date) AS earliest, MAX(adjustment_date) AS latest
    FROM goods_receipts WHERE facility_id = 'none'""")
def agg_global(t):
    none = t.goods_receipts.filter(F.col("facility_id") == "none")
    return none.agg(
        F.count(F.lit(1)).alias("total"), F.min("adjustment_date").alias("earliest"),
        F.max("adjustment_date").alias("latest"),
    )


@case("agg_avg", """
    SELECT facility, ROUND(AVG(transit_days), 6) AS avg_transit_days FROM delivery_lines GROUP BY facility""")
def agg_avg(t):
    return t.delivery_lines.groupBy("facility").agg(
        F.round(F.avg("transit_days"), 6).alias("avg_transit_days")
    )


@case("agg_conditional_pct", """
    SELECT issue, COUNT(*) AS tickets,
           CAST(ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM tickets), 1) AS DOUBLE) AS share_pct
    FROM tickets GROUP BY issue""")
def agg_conditional_pct(t):
    return mix(t.tickets, "issue")


@case("agg_collapse_lines", """
    WITH newest AS (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY order_number
                      ORDER BY shipped_date DESC NULLS LAST, tracking_number DESC, item_name DESC,
                               quantity DESC, delivery_date DESC NULLS LAST) AS rn
        FROM delivery_lines)
    SELECT n.order_number, n.facility, n.carrier_code, n.shipped_date, n.delivery_date,
           a.tracking_numbers, a.shipment_count, a.unique_skus, a.line_count
    FROM newest n JOIN (
        SELECT order_number,
               STRING_AGG(DISTINCT tracking_number, ', ' ORDER BY tracking_number) AS tracking_numbers,
               COUNT(DISTINCT tracking_number) AS shipment_count,
               COUNT(DISTINCT item_name) AS unique_skus, COUNT(*) AS line_count
        FROM delivery_lines GROUP BY order_number) a ON a.order_number = n.order_number
    WHERE n.rn = 1""")
def agg_collapse_lines(t):
    return L.collapse_lines(t.delivery_lines)


@case("agg_default_breakdown", """
    SELECT party_name, CAST(SUM(shipped_quantity) AS BIGINT) AS units, COUNT(*) AS lines
    FROM retail_order_lines GROUP BY GROUPING SETS ((), (party_name))""")
def agg_default_breakdown(t):
    return R.with_total_and_breakdown(
        t.retail_order_lines, "party_name",
        F.sum("shipped_quantity").alias("units"), F.count(F.lit(1)).alias("lines"),
    )


# --- windows -----------------------------------------------------------------------------------


@case("window_dedup_latest", """
    SELECT id, item_number, updated_at FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY item_number
                      ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn
        FROM product_revisions WHERE item_number IS NOT NULL) WHERE rn = 1""")
def window_dedup_latest(t):
    known = t.product_revisions.filter(F.col("item_number").isNotNull())
    order = [F.desc_nulls_last("updated_at"), F.desc("id")]
    return R.newest_per_key(known, ["item_number"], order).select("id", "item_number", "updated_at")


@case("window_latest_per_group", """
    SELECT facility, MAX(snapshot_date) AS snapshot_date,
           CAST(ARG_MAX(quantity, snapshot_date) AS BIGINT) AS onhand_quantity
    FROM (SELECT facility, snapshot_date, SUM(onhand_quantity) AS quantity FROM onhand_eod GROUP BY 1, 2)
    GROUP BY facility""")
def window_latest_per_group(t):
    return Q.current_by_facility(t.onhand_eod)


PREVIOUS_SQL = """
    SELECT event_id, order_number, LAG(event_id) OVER w AS previous_event_id, LAG(issue) OVER w AS previous_issue,
           COALESCE(ts <= LAG(ts) OVER w + INTERVAL 7 DAY, FALSE) AS within_days
    FROM tickets WINDOW w AS (PARTITION BY order_number ORDER BY ts, event_id)"""


@case("window_prev_within_days", PREVIOUS_SQL)
def window_prev_within_days(t):
    linked = R.with_previous(t.tickets, "order_number", "ts", "event_id", ["issue"])
    near = F.col("ts") <= F.col("previous.ts") + F.expr("INTERVAL '7' DAY")
    return linked.select(
        "event_id", "order_number", F.col("previous.event_id").alias("previous_event_id"),
        F.col("previous.issue").alias("previous_issue"),
        F.coalesce(near, F.lit(False)).alias("within_days"),
    )


@case("window_last_n", """
    SELECT source_id, run_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn
        FROM run_log) WHERE rn <= 5""")
def window_last_n(t):
    newest = [F.desc("started_at"), F.desc("run_id")]
    return R.last_n(t.run_log, ["source_id"], newest, 5).select("source_id", "run_id")


# --- ordering and limits -----------------------------------------------------------------------


@case("order_nulls_last", """
    SELECT order_number, tracking_number, item_code, shipped_date, ROW_NUMBER() OVER (
        ORDER BY shipped_date DESC NULLS LAST, order_number, tracking_number, item_code, quantity) AS place
    FROM delivery_lines""")
def order_nulls_last(t):
    """All rows, with their place in the order."""
    rows = t.delivery_lines.select("order_number", "tracking_number", "item_code", "shipped_date", "quantity")
    order = [F.desc_nulls_last("shipped_date"), F.asc("order_number"), F.asc("tracking_number"), F.asc("item_code"), F.asc("quantity")]
    return R.with_place(rows, "place", *order).drop("quantity")


@case("topk", """
    SELECT item_code, CAST(SUM(quantity) AS BIGINT) AS quantity FROM delivery_lines
    GROUP BY item_code ORDER BY quantity DESC, item_code LIMIT 20""")
def topk(t):
    return (
        t.delivery_lines.groupBy("item_code").agg(F.sum("quantity").alias("quantity"))
        .orderBy(F.desc("quantity"), "item_code").limit(20)
    )


@case("result_cap", """
    SELECT order_number, party_name FROM (SELECT DISTINCT order_number, party_name FROM retail_order_lines)
    ORDER BY order_number, party_name LIMIT 50""")
def result_cap(t):
    answer = t.retail_order_lines.select("order_number", "party_name").distinct()
    return answer.orderBy("order_number", "party_name").limit(config.ANSWER_ROW_CAP)


@case("cluster_on_write", "SELECT adjustment_date, facility_id, item_code, adjustment_id FROM goods_receipts")
def cluster_on_write(t):
    path = scratch_path(t.spark, "clustered")
    rows = t.goods_receipts.select("adjustment_date", "facility_id", "item_code", "adjustment_id")
    R.clustered_for_write(
        rows, F.desc("adjustment_date"), "facility_id", "item_code", "adjustment_id"
    ).write.parquet(path)
    return t.spark.read.parquet(path)


@case("curve_on_write", """
    SELECT 'facility' AS wanted, adjustment_id, adjustment_date, facility_id, item_code FROM goods_receipts
    WHERE facility_id = (SELECT MIN(facility_id) FROM goods_receipts)
    UNION ALL
    SELECT 'item', adjustment_id, adjustment_date, facility_id, item_code FROM goods_receipts
    WHERE item_code = (SELECT MIN(item_code) FROM goods_receipts)
    UNION ALL
    SELECT 'date', adjustment_id, adjustment_date, facility_id, item_code FROM goods_receipts
    WHERE adjustment_date = (SELECT MAX(adjustment_date) FROM goods_receipts)""")
def curve_on_write(t):
    """Receipts laid out on a curve through date, facility and item, then read by each of the three alone."""
    path = scratch_path(t.spark, "curve")
    rows = t.goods_receipts.select("adjustment_date", "facility_id", "item_code", "adjustment_id")
    R.write_on_curve(rows, path, ["adjustment_date", "facility_id", "item_code"])
    laid = t.spark.read.schema(rows.schema).parquet(path)
    wanted = laid.agg(F.min("facility_id").alias("facility"), F.min("item_code").alias("item"), F.max("adjustment_date").alias("date")).first()
    parts = [
        laid.filter(F.col(column) == F.lit(wanted[label])).select(F.lit(label).alias("wanted"), "adjustment_id", *rows.columns[:3])
        for label, column in (("facility", "facility_id"), ("item", "item_code"), ("date", "adjustment_date"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- set operations ----------------------------------------------------------------------------


@case("union_all_feeds", f"SELECT region, COUNT(*) AS receipts FROM ({C.INBOUND_SQL}) GROUP BY region")
def union_all_feeds(t):
    feeds = P.all_inbound(t.goods_receipts, t.inbound_other_region)
    return feeds.groupBy("region").agg(F.count(F.lit(1)).alias("receipts"))


@case("distinct_values", "SELECT DISTINCT order_number, tracking_number FROM delivery_lines")
def distinct_values(t):
    return t.delivery_lines.select("order_number", "tracking_number").distinct()


@case("except_both_ways", """
    WITH a AS (SELECT doc_date, item_code, quantity, COUNT(*) AS n FROM shipped_documents GROUP BY ALL),
    b AS (SELECT doc_date, item_code, quantity, COUNT(*) AS n FROM received_documents GROUP BY ALL)
    SELECT doc_date, item_code, quantity, ABS(COALESCE(a.n, 0) - COALESCE(b.n, 0)) AS surplus,
           CASE WHEN COALESCE(a.n, 0) > COALESCE(b.n, 0) THEN 'added' ELSE 'removed' END AS side
    FROM a FULL JOIN b USING (doc_date, item_code, quantity)
    WHERE COALESCE(a.n, 0) <> COALESCE(b.n, 0)""")
def except_both_ways(t):
    return R.both_ways(t.shipped_documents, t.received_documents)


@case("parameterised_sql", """
    SELECT facility_id, item_code, avl_quantity FROM goods_receipts
    WHERE adjustment_date >= DATE '2000-06-30' - 30 AND facility_id = 'F2'""")
def parameterised_sql(t):
    return files.run_sql(
        t.spark,
        """SELECT facility_id, item_code, avl_quantity FROM {receipts}
           WHERE adjustment_date >= date_sub(:as_of, :lookback_days)
             AND (:facility IS NULL OR facility_id = :facility)
             AND (:item_code IS NULL OR item_code = :item_code)""",
        {"as_of": AS_OF, "lookback_days": 30, "facility": "F2", "item_code": None},
        receipts=t.goods_receipts,
    )
