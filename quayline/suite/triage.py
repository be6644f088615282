"""Order lookup cards and ticket rules."""

from pyspark.sql import functions as F

from quayline.operators import triage as T
from quayline.plans import lookup as L, pipelines as P
from quayline.suite import pipelines as C
from quayline.suite.questions import BEST_SQL, ORDERS_SQL
from quayline.suite.registry import AS_OF, case
from quayline.suite.relational import LOOKUP_SQL, curated, tokens_sql


def orders(t):
    return P.delivery_orders(t.delivery_lines)


def lookup(t):
    return L.order_lookup(t.order_requests, *curated(t), t.delivery_lines)


def day_sql(column: str) -> str:
    return f"COALESCE(strftime({column}, '%b %-d'), 'n/a')"


def text_sql(column: str, missing: str = "n/a") -> str:
    return f"COALESCE(CAST({column} AS VARCHAR), '{missing}')"


CARD_SQL = f"""'*Order:* `' || order_number || '`' || chr(10)
    || '*Status:* ' || {text_sql('order_status', 'UNKNOWN')} || chr(10)
    || '*Ordered:* ' || {day_sql('ordered_date')} || ' → *Sent to WH:* ' || {day_sql('sent_to_wh_date')}
    || ' → *Shipped:* ' || {day_sql('first_ship_date')} || ' → *Delivered:* ' || {day_sql('last_delivery_date')}
    || chr(10) || '*Facility:* ' || {text_sql('facilities')} || chr(10)
    || '*Carrier:* ' || {text_sql('carriers')} || ' | *Method:* ' || {text_sql('shipping_method')} || chr(10)
    || '*Tracking:* ' || {text_sql('tracking_numbers')} || chr(10)
    || '*Items:* ' || {text_sql('unique_skus', '?')} || ' SKUs, ' || {text_sql('total_items', '?')}
    || ' items across ' || {text_sql('shipment_count', '?')} || ' shipments' || chr(10)
    || '*Ship to:* ' || CASE WHEN COALESCE(city, '') <> '' AND COALESCE(state, '') <> '' THEN city || ', ' || state
        WHEN COALESCE(city, '') <> '' THEN city WHEN COALESCE(state, '') <> '' THEN state ELSE 'n/a' END"""
SHORT_CARD_SQL = """'*Order:* `' || order_number || '`' || chr(10)
    || '*Shipment data only (no delivery tracking)*'"""


@case("order_lookup", BEST_SQL + """
    SELECT requested, order_number, source, found_in, order_status, order_type, shipment_order_type,
           estimated_delivery_date, shipment_first_ship_date
    FROM best WHERE rn = 1""")
def order_lookup(t):
    return lookup(t).select(
        "requested", "order_number", "source", "found_in", "order_status", "order_type",
        "shipment_order_type", "estimated_delivery_date", "shipment_first_ship_date",
    )


@case("order_card", BEST_SQL + f"""
    SELECT requested, CASE WHEN found_in = 'shipment' THEN {SHORT_CARD_SQL} ELSE {CARD_SQL} END AS card
    FROM best WHERE rn = 1""")
def order_card(t):
    return L.order_card(lookup(t)).select("requested", "card")


REASONS_SQL = " || chr(10) || ".join(
    "'" + reason.replace("'", "''") + "'" for reason in L.NOT_FOUND_REASONS
)


@case("order_not_found", f"""
    WITH {LOOKUP_SQL}
    SELECT requested, {REASONS_SQL} AS reasons FROM requests
    WHERE requested NOT IN (SELECT requested FROM lookup)""")
def order_not_found(t):
    return L.order_not_found(t.order_requests, lookup(t))


POLICY_SQL = """CASE WHEN issue IN ('Missing Items', 'Late Delivery', 'Order Has Not Shipped')
           THEN 'lookup' ELSE 'manual_review' END"""


@case("issue_policy", f"SELECT event_id, issue, {POLICY_SQL} AS policy FROM tickets")
def issue_policy(t):
    return T.issue_policy(t.tickets).select("event_id", "issue", "policy")


AGO = "DATE_DIFF('day', {}, DATE '2000-06-30')"
UNSHIPPED = "'Order has not shipped. Status: ' || order_status || '.'"
TRANSIT_SQL = """CASE WHEN shipping_method = 'GGRNDP' AND requested LIKE 'CA-%' THEN ' Normal transit for GGRNDP is 3-5 days.'
                     WHEN shipping_method = 'GGRNDP' THEN ' Normal transit for GGRNDP is 3-7 days.'
                     WHEN shipping_method = 'G3DAYP' THEN ' Normal transit for G3DAYP is 3 days.'
                     WHEN shipping_method = 'G2DAYP' THEN ' Normal transit for G2DAYP is 2 days.'
                     WHEN shipping_method = 'GNXDYP' THEN ' Normal transit for GNXDYP is 1 days.' ELSE '' END"""
ASSESSMENT_SQL = f"""
    CASE WHEN issue LIKE 'Return %' AND warranty_ship_date IS NOT NULL THEN 'A warranty shipment left on '
              || {day_sql('warranty_ship_date')} || '. Tracking: ' || {text_sql('warranty_tracking')} || '.'
         WHEN policy = 'manual_review' THEN 'This issue type (' || issue || ') requires manual review.'
         WHEN order_status IS NULL THEN 'Order not found in delivery tracking data.'
         WHEN issue = 'Missing Items' THEN
           CASE WHEN order_status = 'DELIVERED' AND shipment_count > 1 THEN 'Order was split across '
                     || shipment_count || ' shipments. All shipments show as delivered. Seller may need to check all packages.'
                WHEN order_status = 'DELIVERED' THEN 'Order shows as delivered in one shipment.'
                WHEN order_status = 'PARTIALLY_DELIVERED' THEN 'Order has ' || shipment_count
                     || ' shipments but not all have been delivered yet.'
                WHEN order_status = 'SHIPPED' THEN 'Order shipped on ' || {day_sql('first_ship_date')}
                     || ', currently in transit. Estimated delivery: ' || {day_sql('estimated_delivery_date')} || '.'
                ELSE {UNSHIPPED} END
         WHEN issue = 'Late Delivery' THEN
           CASE WHEN order_status IN ('DELIVERED', 'PARTIALLY_DELIVERED') THEN 'Order delivered on '
                     || {day_sql('last_delivery_date')} || ', '
                     || DATE_DIFF('day', ordered_date, last_delivery_date) || ' days after order. Transit was '
                     || {text_sql('transit_days')} || ' days.'
                WHEN first_ship_date IS NOT NULL AND order_status <> 'CANCELLED' THEN 'Order shipped ' || {AGO.format('first_ship_date')}
                     || ' days ago, still in transit.' || {TRANSIT_SQL}
                ELSE {UNSHIPPED} END
         ELSE
           CASE WHEN order_status = 'AT_WAREHOUSE' THEN 'Order sent to warehouse on '
                     || {day_sql('sent_to_wh_date')} || ' (' || {AGO.format('sent_to_wh_date')}
                     || ' days ago). Not yet shipped.'
                WHEN first_ship_date IS NOT NULL AND order_status <> 'CANCELLED' THEN 'Order actually shipped on '
                     || {day_sql('first_ship_date')} || '. Tracking: ' || {text_sql('tracking_numbers')} || '.'
                WHEN order_status = 'ORDERED' THEN 'Order placed on ' || {day_sql('ordered_date')}
                     || ' but not yet sent to warehouse.'
                ELSE {UNSHIPPED} END
    END"""


RETURN_SQL = """CASE WHEN order_type = 'Return' AND issue = 'Damaged Order' THEN 'Return Not Delivered'
           WHEN order_type = 'Return' AND issue = 'Address Change Request' THEN 'Return Delivered, But No Refund'
           ELSE issue END"""
WARRANTY_SQL = f"SELECT * FROM ({C.SHIPMENTS_SQL}) WHERE order_type LIKE '%WARRANTY%'"


@case("triage_assessment", f"""{ORDERS_SQL}
    SELECT event_id, requested AS order_number, policy, order_status, {ASSESSMENT_SQL} AS assessment
    FROM (SELECT t.event_id, t.order_number AS requested, t.issue, {POLICY_SQL} AS policy,
                 o.* EXCLUDE (order_number), w.shipment_first_ship_date AS warranty_ship_date,
                 w.shipment_tracking AS warranty_tracking
          FROM (SELECT * EXCLUDE (issue), {RETURN_SQL} AS issue FROM tickets) t
          LEFT JOIN o ON o.order_number = REPLACE(t.order_number, '-WR', '')
          LEFT JOIN ({tokens_sql(WARRANTY_SQL)}) w ON w.order_token = REPLACE(t.order_number, '-WR', ''))""")
def triage_assessment(t):
    """Tickets about returns, also those that their order type alone tells, report warranty shipments."""
    tickets = t.tickets.withColumn("issue", F.expr(RETURN_SQL))
    warranty = L.warranty_shipments(P.shipments(t.outbound_lines, AS_OF))
    assessed = T.triage_assessment(tickets, orders(t), AS_OF, warranty)
    return assessed.select("event_id", "order_number", "policy", "order_status", "assessment")


@case("processing_sla_band", f"""{ORDERS_SQL}
    SELECT order_number, processing_days, CASE WHEN processing_days <= 2 THEN 'normal'
        WHEN processing_days IN (3, 4) THEN 'warning' WHEN processing_days >= 5 THEN 'critical' END AS band FROM o""")
def processing_sla_band(t):
    band = T.processing_band(F.col("processing_days"))
    return orders(t).select("order_number", "processing_days", band.alias("band"))


@case("transit_sla_band", f"""{ORDERS_SQL}
    SELECT order_number, shipping_method, expected_days, transit_days > 2 * expected_days AS over_twice_expected,
           CASE WHEN transit_days > 10 THEN 'overdue' WHEN transit_days > 2 * expected_days THEN 'warning'
                WHEN transit_days > CASE WHEN shipping_method = 'GGRNDP' THEN 5 ELSE 3 END THEN 'delayed'
                WHEN transit_days IS NOT NULL THEN 'on_time' END AS transit_band
    FROM (SELECT *, CASE shipping_method WHEN 'GGRNDP' THEN CASE WHEN order_number LIKE 'CA-%' THEN 5 ELSE 7 END WHEN 'G3DAYP' THEN 3 WHEN 'G2DAYP' THEN 2
                 WHEN 'GNXDYP' THEN 1 END AS expected_days FROM o)""")
def transit_sla_band(t):
    return T.transit_band(orders(t)).select(
        "order_number", "shipping_method", "expected_days", "over_twice_expected", "transit_band"
    )


@case("lost_package", f"""{ORDERS_SQL}
    SELECT order_number, COALESCE(order_status NOT IN ('DELIVERED', 'CANCELLED')
           AND LEN(LIST_FILTER(GENERATE_SERIES(estimated_delivery_date + 1, DATE '2000-06-30', INTERVAL 1 DAY),
                   lambda d: ISODOW(d) < 6)) >= 10, FALSE) AS lost FROM o""")
def lost_package(t):
    return orders(t).select("order_number", T.is_lost(AS_OF).alias("lost"))


@case("late_ship_delivery", f"""{ORDERS_SQL}
    SELECT order_number, processing_days > 2 AS shipped_late, transit_days > 5 AS delivered_late,
           COALESCE(order_status = 'AT_WAREHOUSE'
                    AND DATE_DIFF('day', sent_to_wh_date, DATE '2000-06-30') > 3, FALSE) AS stuck_at_warehouse
    FROM o""")
def late_ship_delivery(t):
    return T.late_flags(orders(t), AS_OF).select(
        "order_number", "shipped_late", "delivered_late", "stuck_at_warehouse"
    )


@case("claim_window", f"""{ORDERS_SQL}
    SELECT order_number, carrier, first_ship_date, last_delivery_date, start + first_day AS opens_on,
           start + last_day AS closes_on,
           COALESCE(DATE '2000-06-30' BETWEEN start + first_day AND start + last_day, FALSE) AS is_open
    FROM (SELECT *, CASE carrier WHEN 'ups' THEN last_delivery_date WHEN 'ups-mi' THEN NULL
                         ELSE first_ship_date END AS start,
                 CASE carrier WHEN 'usps' THEN 15 ELSE 0 END AS first_day,
                 CASE carrier WHEN 'purolator-v2' THEN 30 WHEN 'fedex-freight' THEN 21 ELSE 60 END AS last_day
          FROM (SELECT order_number, first_ship_date, last_delivery_date,
                       UNNEST(STRING_SPLIT(carriers, ', ')) AS carrier FROM o))""")
def claim_window(t):
    return T.claim_window(orders(t), AS_OF)


@case("replacement_eligibility", f"""{ORDERS_SQL}
    SELECT order_number, CASE WHEN last_delivery_date IS NULL THEN 'not_delivered'
        WHEN DATE_DIFF('day', last_delivery_date, DATE '2000-06-30') > 30 THEN 'limited' ELSE 'eligible' END
        AS replacement FROM o""")
def replacement_eligibility(t):
    return orders(t).select("order_number", T.replacement_eligibility(AS_OF).alias("replacement"))


@case("address_change_rule", f"""{ORDERS_SQL}
    SELECT order_number, order_status, CASE
        WHEN order_status IN ('SHIPPED', 'DELIVERED', 'PARTIALLY_DELIVERED') THEN 'refused'
        WHEN order_status = 'CANCELLED' THEN 'not_applicable' ELSE 'possible' END AS address_change FROM o""")
def address_change_rule(t):
    rule = T.address_change_rule(F.col("order_status"))
    return orders(t).select("order_number", "order_status", rule.alias("address_change"))


@case("escalation_route", """
    SELECT event_id, CASE WHEN order_number LIKE 'GB-%' THEN 'eu_apac_team'
        WHEN order_number LIKE '%-WR' THEN 'warranty_team'
        WHEN order_number LIKE 'CA-%' AND order_type = 'Return' THEN 'ca_returns_team'
        WHEN issue = 'Address Change Request' THEN 'warehouse_team' ELSE 'delivery_help_desk' END AS team
    FROM tickets""")
def escalation_route(t):
    team = T.escalation_team(F.col("issue"), F.col("order_number"), F.col("order_type"))
    return t.tickets.select("event_id", team.alias("team"))


DUPLICATE_SQL = """
    SELECT event_id, order_number, issue, previous_event_id,
           CASE WHEN order_number LIKE '%-WR' THEN 'warranty'
                WHEN previous_ts IS NULL OR ts > previous_ts + INTERVAL 7 DAY THEN 'new'
                WHEN previous_issue = issue THEN 'duplicate' ELSE 'escalation' END AS ticket_kind
    FROM (SELECT *, LAG(event_id) OVER w AS previous_event_id, LAG(ts) OVER w AS previous_ts,
                 LAG(issue) OVER w AS previous_issue
          FROM tickets WINDOW w AS (PARTITION BY order_number ORDER BY ts, event_id))"""


@case("duplicate_ticket", DUPLICATE_SQL)
def duplicate_ticket(t):
    return T.duplicate_tickets(t.tickets).select(
        "event_id", "order_number", "issue", "previous_event_id", "ticket_kind"
    )


@case("ticket_mix", f"""
    SELECT issue, ticket_kind, COUNT(*) AS tickets,
           CAST(ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM tickets), 1) AS DOUBLE) AS share_pct
    FROM ({DUPLICATE_SQL}) GROUP BY issue, ticket_kind""")
def ticket_mix(t):
    return T.mix(T.duplicate_tickets(t.tickets), "issue", "ticket_kind")
