"""Operations feeds derived from the given star-schema tables.

Each feed is one SQL text that Spark and DuckDB both run unchanged, so that the checks start from
the same rows. Table names stand in braces: Spark binds DataFrames to them, the check binds views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def text(value: str) -> str:
    return f"CAST({value} AS VARCHAR(20))"


def country(key: str) -> str:
    return f"CASE {key} % 10 WHEN 7 THEN 'CA' WHEN 9 THEN 'GB' ELSE 'US' END"


def order_number(key: str) -> str:
    return f"CONCAT({country(key)}, '-', LPAD({text(key)}, 9, '0'))"


SHIP_METHOD = """CASE l.l_suppkey % 4 WHEN 0 THEN 'GGRNDP' WHEN 1 THEN 'G3DAYP'
            WHEN 2 THEN 'G2DAYP' ELSE 'GNXDYP' END"""
CARRIER = """CASE l.l_suppkey % 5 WHEN 0 THEN 'usps' WHEN 1 THEN 'fedex' WHEN 2 THEN 'ups'
            WHEN 3 THEN 'purolator-v2' ELSE 'ups-mi' END"""

FEEDS: dict[str, str] = {}

FEEDS["delivery_lines"] = f"""
    SELECT d.*,
           d.line_date - CAST(d.processing_days AS INTEGER) AS ordered_date,
           CASE WHEN d.is_delivered THEN d.shipped_date + CAST(d.transit_days AS INTEGER) END
               AS delivery_date,
           CASE WHEN d.is_delivered THEN d.processing_days + d.transit_days END
               AS days_to_delivery,
           d.shipped_date + 5 AS estimated_delivery_date,
           CASE WHEN d.is_delivered THEN 'Delivered' WHEN d.shipped_date IS NOT NULL
                THEN 'In transit' ELSE 'Pending' END AS delivery_status
    FROM (
    SELECT {order_number('l.l_orderkey')} AS order_number,
           l.l_orderkey AS source_order_number,
           'ECOMMERCE' AS customer_name,
           {country('l.l_orderkey')} AS country,
           CASE WHEN o.o_custkey % 7 = 0 THEN NULL
                ELSE CONCAT('S', {text('o.o_custkey % 50')}) END AS state,
           CASE WHEN o.o_custkey % 11 = 0 THEN '' ELSE CONCAT('City', {text('o.o_custkey % 200')})
                END AS city,
           CONCAT('F', {text('l.l_suppkey % 3')}) AS facility,
           {CARRIER} AS carrier_code,
           {SHIP_METHOD} AS shipping_method,
           CASE WHEN l.l_orderkey % 20 = 3 THEN 'ECOM_WARRANTY_SHIPONLY'
                ELSE 'ECOM_NORMAL_SHIPONLY' END AS order_type,
           (l.l_linenumber > 4) AS is_split_order,
           CONCAT({text('l.l_orderkey')}, '-', {text('l.l_suppkey')}) AS tracking_number,
           CONCAT('Item', {text('l.l_partkey')}) AS item_name,
           l.l_partkey AS item_code,
           CAST(l.l_quantity AS BIGINT) AS quantity,
           CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'P' THEN 'Y' ELSE 'N' END
               AS cancelled_flag,
           l.l_partkey % 8 AS processing_days,
           (l.l_suppkey * 7 + l.l_linenumber) % 14 AS transit_days,
           CAST(l.l_shipdate AS DATE) AS line_date,
           CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                ELSE CAST(l.l_shipdate AS DATE) END AS sent_to_warehouse_date,
           CASE WHEN o.o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN NULL
                ELSE CAST(l.l_shipdate AS DATE) END AS shipped_date,
           (l.l_linestatus = 'F' AND o.o_orderpriority NOT IN ('3-MEDIUM', '4-NOT SPECIFIED'))
               AS is_delivered
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey) d"""

FEEDS["outbound_lines"] = f"""
    SELECT {order_number('l.l_orderkey')} AS order_token,
           l.l_orderkey * 10 + l.l_suppkey % 2 AS order_number,
           CASE WHEN l.l_orderkey % 20 = 3 THEN 'ECOM_WARRANTY_SHIPONLY'
                WHEN l.l_orderkey % 20 = 4 THEN 'RETAIL_NORMAL_STANDARD'
                ELSE 'ECOM_NORMAL_SHIPONLY' END AS order_type_code,
           CASE WHEN l.l_orderkey % 20 = 3 THEN 'Warranty' ELSE 'Normal' END AS order_type_name,
           CASE WHEN l.l_orderkey % 20 = 4 THEN 'RETAIL' ELSE 'ECOM' END AS eff_order_type,
           CASE WHEN l.l_orderkey % 20 = 4 THEN 'Retail' ELSE 'Online' END AS sales_channel,
           {country('l.l_orderkey')} AS country,
           CONCAT('Receiver', {text('l.l_orderkey % 1000')}) AS ship_to_name,
           CONCAT('F', {text('l.l_suppkey % 3')}) AS facility_id,
           {CARRIER} AS carrier_code,
           {SHIP_METHOD} AS ship_method,
           CAST(l.l_shipdate AS DATE) AS shipping_date,
           l.l_partkey AS item_code,
           CAST(l.l_quantity AS BIGINT) AS quantity,
           CONCAT({text('l.l_orderkey')}, '-', {text('l.l_suppkey')}) AS tracking_number,
           CAST(l.l_linenumber AS BIGINT) AS number_packages,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS std_cost,
           CASE WHEN l.l_linenumber % 2 = 0 THEN CONCAT('SN', {text('l.l_partkey')}) END
               AS serial_number,
           CONCAT('CL', {text('l.l_suppkey % 4')}) AS client_code,
           CONCAT('Product', {text('l.l_partkey')}) AS product_name,
           l.l_returnflag AS process_flag,
           CASE WHEN l.l_discount > 0.05 THEN 'Y' ELSE 'N' END AS is_expedited
    FROM {{lineitem}} l"""

FEEDS["receipts_source"] = f"""
    SELECT l.l_shipdate AS adjustment_date,
           CONCAT('F', {text('l.l_suppkey % 4')}) AS facility_id,
           l.l_partkey AS item_code,
           CONCAT(p.p_brand, ' ', p.p_type) AS item_description,
           CASE WHEN l.l_partkey % 9 = 0 THEN '' WHEN l.l_partkey % 9 = 1 THEN NULL
                ELSE p.p_name END AS product_name,
           CONCAT('CL', {text('l.l_suppkey % 4')}) AS client_code,
           l.l_orderkey AS adjustment_id,
           CASE WHEN l.l_returnflag <> 'R' AND l.l_linestatus = 'F'
                THEN CAST(l.l_quantity AS BIGINT) END AS avl_quantity,
           CASE WHEN l.l_returnflag <> 'R' AND l.l_linestatus = 'O'
                THEN CAST(l.l_quantity AS BIGINT) END AS unavl_quantity,
           CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS BIGINT) END AS return_quantity,
           CASE WHEN l.l_linenumber < 7 THEN CAST(p.p_retailprice AS DECIMAL(18,2)) END AS std_cost,
           CASE WHEN l.l_linenumber < 7 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END
               AS extended_cost,
           CONCAT('file', {text('l.l_linenumber')}, '.txt') AS file_name,
           l.l_returnflag AS process_flag,
           CASE WHEN l.l_tax < 0.07 THEN 'T1' ELSE 'T9' END AS tenant,
           CASE WHEN l.l_discount < 0.09 THEN 'STAT' ELSE 'HOLD' END AS remarks
    FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey"""

FEEDS["goods_receipts"] = f"""
    SELECT CAST(l.l_shipdate AS DATE) AS adjustment_date,
           CONCAT('F', {text('l.l_suppkey % 3')}) AS facility_id,
           l.l_partkey AS item_code,
           CONCAT(p.p_brand, ' ', p.p_type) AS item_description,
           CASE WHEN l.l_partkey % 9 = 0 THEN '' WHEN l.l_partkey % 9 = 1 THEN NULL
                ELSE p.p_name END AS product_name,
           CONCAT('CL', {text('l.l_suppkey % 4')}) AS client_code,
           l.l_orderkey AS adjustment_id,
           CASE WHEN l.l_returnflag <> 'R' AND l.l_linestatus = 'F'
                THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END AS avl_quantity,
           CASE WHEN l.l_returnflag <> 'R' AND l.l_linestatus = 'O'
                THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END AS unavl_quantity,
           CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END
               AS return_quantity,
           CAST(p.p_retailprice AS DECIMAL(18,2)) AS std_cost,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS extended_cost,
           CONCAT('file', {text('l.l_linenumber')}, '.txt') AS file_name,
           l.l_returnflag AS process_flag,
           l.l_shipdate AS fetched_at
    FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey"""

FEEDS["inbound_other_region"] = f"""
    SELECT CAST(l.l_shipdate AS DATE) + 10 AS arrival_date,
           CONCAT('E', {text('l.l_suppkey % 4')}) AS facility,
           l.l_partkey AS sku,
           CAST(l.l_quantity AS BIGINT) + l.l_linenumber % 3 AS received_quantity,
           CASE WHEN l.l_suppkey % 2 = 0 THEN 'EU' ELSE 'APAC' END AS region
    FROM {{lineitem}} l"""

FEEDS["shipped_documents"] = """
    SELECT CAST(l.l_shipdate AS DATE) AS doc_date, l.l_partkey AS item_code,
           CAST(l.l_quantity AS BIGINT) AS quantity
    FROM {lineitem} l WHERE l.l_returnflag <> 'R'"""

FEEDS["received_documents"] = """
    SELECT CAST(l.l_shipdate AS DATE) AS doc_date, l.l_partkey AS item_code,
           CASE WHEN l.l_linenumber = 1 THEN CAST(l.l_quantity AS BIGINT) - 1
                WHEN l.l_linenumber = 2 THEN CAST(l.l_quantity AS BIGINT) + 1
                ELSE CAST(l.l_quantity AS BIGINT) END AS quantity
    FROM {lineitem} l WHERE l.l_tax > 0.01"""

FEEDS["onhand_eod"] = f"""
    SELECT l.l_orderkey * 10 + l.l_linenumber AS id,
           CAST(l.l_shipdate AS DATE) AS snapshot_date,
           s.s_nationkey AS facility,
           l.l_partkey AS item_code,
           CONCAT('SUB', {text('l.l_linenumber')}) AS sub_inventory,
           CAST(l.l_quantity AS BIGINT) AS onhand_quantity,
           CAST(l.l_linenumber AS BIGINT) AS committed_quantity,
           'EA' AS uom,
           CONCAT('L', {text('l.l_suppkey')}) AS location,
           CONCAT('CL', {text('l.l_suppkey % 4')}) AS client_code,
           l.l_partkey % 90 AS days_inventory,
           CASE WHEN l.l_tax < 0.07 THEN 'T1' ELSE 'T9' END AS tenant,
           l.l_shipdate AS created_at,
           l.l_shipdate AS updated_at
    FROM {{lineitem}} l JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey"""

FEEDS["stock_lots"] = """
    SELECT l.l_partkey AS product_number,
           CASE l.l_partkey % 5 WHEN 0 THEN '3P' WHEN 1 THEN '3P' WHEN 2 THEN NULL ELSE '1P' END
               AS product_type,
           CONCAT('W', CAST(l.l_suppkey % 7 AS VARCHAR(10))) AS warehouse,
           CASE l.l_linenumber % 4 WHEN 0 THEN 'Available' WHEN 1 THEN 'Return' WHEN 2 THEN 'Hold'
                ELSE 'Unavailable' END AS status,
           CAST(l.l_shipdate AS DATE) AS receive_date,
           DATE '2001-12-31' AS snapshot_date,
           CAST(l.l_quantity AS BIGINT) AS quantity,
           CAST(l.l_partkey % 100 + 900 AS DECIMAL(18,2)) AS unit_cost_usd
    FROM {lineitem} l"""

FEEDS["product_revisions"] = f"""
    SELECT e.event_id AS id,
           CASE WHEN e.event_id % 50 = 0 THEN NULL ELSE e.user_id END AS item_number,
           CONCAT('Item', {text('e.user_id')}) AS item_name,
           CONCAT('Category', {text('e.user_id % 6')}) AS item_category,
           CASE e.event_type WHEN 'signup' THEN 'Released' WHEN 'view' THEN 'In Production'
                WHEN 'click' THEN 'Concept' ELSE 'Obsolete' END AS lifecycle_phase,
           CONCAT('R', {text('e.event_id % 26')}) AS revision,
           CONCAT('Family', {text('e.user_id % 8')}) AS product_family,
           CASE WHEN e.event_id % 40 = 3 THEN NULL ELSE e.ts END AS updated_at
    FROM {{events}} e"""

FEEDS["packaging_versions"] = f"""
    SELECT o.o_custkey AS sku, o.o_orderkey AS version_id, CAST(o.o_orderdate AS DATE) AS valid_from,
           CASE WHEN o.o_orderkey = c.current_version THEN NULL
                ELSE CAST(o.o_orderdate AS DATE) + 30 END AS valid_to,
           CONCAT('PC', {text('o.o_custkey % 12')}) AS product_category,
           CASE WHEN o.o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS serialized_item,
           o.o_orderkey % 40 AS units_per_master_carton,
           o.o_orderkey % 900 AS units_per_ocean_pallet
    FROM {{orders}} o
    JOIN (SELECT o_custkey, MAX(o_orderkey) AS current_version FROM {{orders}} GROUP BY o_custkey) c
      ON c.o_custkey = o.o_custkey"""

FEEDS["po_details"] = f"""
    SELECT l.l_orderkey AS po_number, l.l_linenumber AS po_line_number,
           l.l_orderkey + 1000000 AS po_header_id, l.l_partkey AS item_id,
           CONCAT('A-SKU-', LPAD({text('l.l_partkey')}, 6, '0')) AS item_number,
           CONCAT('Supplier', {text('l.l_suppkey')}) AS supplier_name,
           CONCAT('Site', {text('l.l_suppkey % 10')}) AS supplier_site,
           CONCAT('F', {text('l.l_suppkey % 3')}) AS warehouse,
           l.l_linestatus AS po_header_status,
           CONCAT('Part ', {text('l.l_partkey')}) AS description,
           CAST(l.l_quantity AS BIGINT) AS po_line_qty, l.l_returnflag AS po_line_status,
           CONCAT('L', {text('l.l_suppkey')}) AS location_name,
           CONCAT('BU', {text('l.l_suppkey % 2')}) AS procurement_bu,
           'INVENTORY' AS destination_type_code,
           CAST(l.l_shipdate AS DATE) + 30 AS requested_delivery_date,
           CAST(l.l_shipdate AS DATE) AS po_apprvl_dt,
           l.l_shipdate AS created_at, l.l_shipdate AS updated_at
    FROM {{lineitem}} l"""

PARTY = """CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Building Stores, Inc'
           WHEN 'AUTOMOBILE' THEN 'Automobile Purchasing LLC'
           WHEN 'MACHINERY' THEN 'Machinery Fulfillment Services, Inc'
           WHEN 'HOUSEHOLD' THEN 'Household Supply UK' ELSE 'FURNITURE TRADE' END"""

FEEDS["retail_order_lines"] = f"""
    SELECT l.l_orderkey AS order_number,
           CONCAT('PO', LPAD({text('o.o_custkey')}, 8, '0')) AS customer_po_number,
           CONCAT({PARTY}, CASE c.c_nationkey % 2 WHEN 0 THEN ' (US)' ELSE ' (EU)' END)
               AS party_name,
           l.l_partkey AS item_number,
           CONCAT('Part ', {text('l.l_partkey')}) AS item_description,
           CAST(l.l_partkey % 100 + 900 + l.l_suppkey % 3 AS DECIMAL(18,2)) AS unit_selling_price,
           CAST(l.l_quantity AS BIGINT) AS ordered_qty,
           CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END
               AS shipped_quantity,
           CASE WHEN o.o_orderstatus = 'P' THEN 'ENTERED' WHEN l.l_linestatus = 'F' THEN 'CLOSED'
                WHEN l.l_returnflag = 'R' THEN 'CANCELLED' ELSE 'AWAITING_SHIPPING' END
               AS status_code,
           CAST(o.o_orderdate AS DATE) AS ordered_date,
           CAST(l.l_shipdate AS DATE) AS ship_date,
           CAST(l.l_extendedprice AS DECIMAL(18,2)) AS extended_amount
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
    JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""

FEEDS["retail_order_exceptions"] = f"""
    SELECT o.o_orderkey AS exception_id,
           CONCAT('PO', LPAD({text('o.o_custkey')}, 8, '0')) AS po_number,
           CAST(o.o_orderdate AS DATE) AS ordered_date,
           CASE WHEN o.o_custkey % 2 = 0 THEN 'BU_US' ELSE 'BU_EU' END AS business_unit,
           CONCAT('Category ', o.o_orderpriority) AS error_category,
           CONCAT('Error on order ', {text('o.o_orderkey')}) AS error_message
    FROM {{orders}} o WHERE o.o_orderstatus = 'P'"""

FEEDS["item_dimension"] = """
    SELECT p.p_partkey AS item_number, p.p_name AS item_name, p.p_type AS product_family,
           CASE p.p_size % 4 WHEN 0 THEN 'Released' WHEN 1 THEN 'In Production'
                WHEN 2 THEN 'Concept' ELSE 'Obsolete' END AS lifecycle_phase,
           p.p_brand AS product_category
    FROM {part} p"""

TICKET_KEY = "e.user_id"
FEEDS["tickets"] = f"""
    SELECT e.event_id, e.ts,
           CONCAT({order_number(TICKET_KEY)},
                  CASE WHEN e.user_id % 13 = 5 THEN '-WR' ELSE '' END) AS order_number,
           CASE e.event_type WHEN 'error' THEN 'Damaged Order' WHEN 'click' THEN 'Late Delivery'
                WHEN 'view' THEN 'Order Has Not Shipped' WHEN 'signup' THEN 'Address Change Request'
                ELSE 'Missing Items' END AS issue,
           CASE e.event_id % 3 WHEN 0 THEN '$0-200' WHEN 1 THEN '$200-500' ELSE '$500+' END
               AS order_value,
           CASE e.event_id % 4 WHEN 0 THEN 'Return' ELSE 'Outbound' END AS order_type,
           CONCAT('Team ', {text('e.user_id % 5')}) AS team,
           CONCAT('<@U', {text('e.user_id')}, '>') AS sender
    FROM {{events}} e"""

FEEDS["ticket_posts"] = """
    SELECT t.event_id, t.ts,
           CONCAT('*Order Number:* ', t.order_number, '\n*Order Value:* ', t.order_value,
                  '\n*Order Type:* ', t.order_type, '\n*Issue:* ', t.issue, '\n*Team:* ', t.team,
                  '\n*From:* ', t.sender, '\n*Details:* box ', CAST(t.event_id AS VARCHAR(20)),
                  ' arrived late') AS body
    FROM {tickets} t"""

FEEDS["order_requests"] = f"""
    SELECT CONCAT({order_number('o.o_orderkey')},
                  CASE WHEN o.o_orderkey % 13 = 5 THEN '-wr' ELSE '' END) AS order_number
    FROM {{orders}} o"""

FEEDS["retail_requests"] = f"""
    SELECT CONCAT(' po', LPAD({text('c.c_custkey')}, 8, '0'), ' ') AS identifier FROM {{customer}} c
    UNION ALL
    SELECT CASE WHEN o.o_orderpriority = '1-URGENT' THEN {order_number('o.o_orderkey')}
                WHEN o.o_orderpriority = '2-HIGH' THEN '?' ELSE {text('o.o_orderkey')} END
    FROM {{orders}} o"""

MESSAGE_BODY = f"""CASE e.event_id % 16
           WHEN 0 THEN CONCAT('Where is order ', LOWER({order_number(TICKET_KEY)}), '?')
           WHEN 1 THEN 'hello!'
           WHEN 2 THEN 'thanks for the quick answer'
           WHEN 3 THEN CONCAT('> _*how many units at imc for a-sku-', LPAD({text('e.user_id')}, 4, '0'), '*_')
           WHEN 4 THEN 'the quantity at the facility is fine'
           WHEN 5 THEN CONCAT('status of PO WM', LPAD({text('e.user_id')}, 8, '0'))
           WHEN 6 THEN CONCAT('item ', {text('37000000 + e.user_id')}, ' arrived')
           WHEN 7 THEN '   '
           WHEN 8 THEN CONCAT('*Order Number:* ', {order_number(TICKET_KEY)}, '-WR damaged')
           WHEN 9 THEN 'how are you'
           WHEN 10 THEN 'who are you'
           WHEN 11 THEN 'inventory on hand at GBR last week'
           WHEN 12 THEN 'what came in to NLD yesterday'
           WHEN 13 THEN CONCAT('thanks, and ', {order_number(TICKET_KEY)}, ' too')
           WHEN 14 THEN 'price for retail customers this week'
           ELSE 'lunch is at noon' END"""
FEEDS["channel_messages"] = f"""
    SELECT CONCAT('C', {text('e.user_id % 6')}) AS channel,
           CONCAT('17', LPAD({text('e.event_id')}, 8, '0'), '.5') AS message_ts,
           e.event_id, e.ts,
           CASE WHEN e.event_id % 16 = 8 THEN 'bot_message' WHEN e.event_id % 37 = 0 THEN 'channel_join'
                END AS subtype,
           CONCAT('U', {text('e.user_id')}) AS author,
           e.event_id % 3 AS reply_count,
           {MESSAGE_BODY} AS body
    FROM {{events}} e"""

FEEDS["transcripts"] = """
    SELECT m.event_id,
           CONCAT('## Tool output\nintro line\n### Message (ts: ', m.message_ts, ')\nuser: @', m.author,
                  CASE WHEN m.subtype IS NULL THEN '' ELSE CONCAT('\nsubtype: ', m.subtype) END,
                  '\nreply_count: ', CAST(m.reply_count AS VARCHAR(10)),
                  '\nthread_ts: 1\nreactions: one\n  first line of ', CAST(m.event_id AS VARCHAR(20)),
                  '  \n\nsecond line\n### Reply (ts: ', m.message_ts, '1)\nuser: @BOT\nok ',
                  CAST(m.event_id AS VARCHAR(20)),
                  '\nShowing only recent messages\nnot part\n### Late (ts: 9.9)\nlost') AS dump
    FROM {channel_messages} m"""

FEEDS["thread_messages"] = f"""
    SELECT c.conv_id AS thread_id, c.turn,
           CASE WHEN c.role = 'assistant' THEN 'BOT' ELSE CONCAT('U', {text('c.conv_id % 20')}) END
               AS author,
           CASE WHEN c.turn % 3 = 2 AND c.role <> 'assistant'
                THEN CONCAT('<@BOT> ', c.text) ELSE c.text END AS body
    FROM {{conversations}} c"""

FEEDS["mention_threads"] = f"""
    SELECT CONCAT('C', {text('m.thread_id % 6')}) AS channel, m.thread_id, m.turn, m.author,
           CASE WHEN m.turn = 0 AND m.thread_id % 3 = 0
                THEN CONCAT('Where is ', {order_number('m.thread_id')}, '? ', m.body)
                WHEN m.turn = 0 AND m.thread_id % 3 = 1 THEN CONCAT('About the inventory: ', m.body)
                WHEN m.turn % 3 = 2 AND m.thread_id % 7 = 0
                THEN CONCAT('<@BOT> and ', {order_number('m.thread_id + 1')}, ' then?')
                WHEN m.turn % 3 = 2 AND m.thread_id % 7 = 1 THEN '<@BOT> thanks'
                WHEN m.turn % 3 = 2 AND m.thread_id % 7 = 2 THEN '<@BOT> any receipt yet?'
                ELSE m.body END AS body,
           TIMESTAMP '2024-01-30 08:30:00' + INTERVAL '1' SECOND * (m.thread_id * 61 % 10000 + m.turn * 240)
               + INTERVAL '0.001' SECOND * (m.thread_id % 1000) AS event_time
    FROM {{thread_messages}} m"""

FEEDS["run_log"] = f"""
    SELECT e.event_id AS run_id,
           CONCAT('source', {text('e.user_id % 5')}) AS source_id,
           e.ts AS started_at,
           e.ts + INTERVAL '90' SECOND AS finished_at,
           CASE e.event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'skipped'
                ELSE 'success' END AS status,
           CAST(e.event_id % 1000 AS BIGINT) AS rows_fetched
    FROM {{events}} e"""

REFERENCE = re.compile(r"\{(\w+)\}")


def feed_inputs(name: str) -> list[str]:
    return sorted(set(REFERENCE.findall(FEEDS[name])))


class Feeds:
    """The base tables of one folder and the feeds over them, as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in FEEDS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in FEEDS:
                inputs = {i: getattr(self, i) for i in feed_inputs(name)}
                self._frames[name] = self.spark.sql(FEEDS[name], **inputs)
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]


def feed_ctes(body: str) -> list[str]:
    """The CTE definitions that a check query naming feeds needs, inputs first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in feed_inputs(name):
            if parent in FEEDS:
                visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in FEEDS:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    return [f"{name} AS ({REFERENCE.sub(lambda m: m.group(1), FEEDS[name])})" for name in ordered]
