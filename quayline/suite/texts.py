"""Message parsing and classification."""

from pyspark.sql import functions as F

from quayline import config
from quayline.functions import messages as M
from quayline.plans import lookup as L
from quayline.suite.registry import case


def alternatives(words: list[str]) -> str:
    return "(" + "|".join(w.replace("'", "''") for w in words) + ")"


def contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def starts_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


@case("parse_transcript", """
    SELECT event_id, 0 AS position, message_ts AS ts, author, subtype, CAST(reply_count AS INTEGER) AS reply_count,
           'first line of ' || event_id || ' second line' AS body FROM channel_messages
    UNION ALL
    SELECT event_id, 1, message_ts || '1', 'BOT', NULL, 0, 'ok ' || event_id FROM channel_messages""")
def parse_transcript(t):
    parsed = M.transcript_messages(F.col("dump"))
    rows = t.transcripts.select("event_id", F.posexplode(parsed).alias("position", "message"))
    return rows.select("event_id", "position", "message.*")


CLEAN_SQL = r"""TRIM(REGEXP_REPLACE(TRIM(REGEXP_REPLACE(TRIM(REGEXP_REPLACE(TRIM(body), '^>\s*', '')),
           '^_|_$', '', 'g')), '^\*|\*$', '', 'g'))"""


@case("clean_markup", f"SELECT event_id, {CLEAN_SQL} AS clean FROM channel_messages")
def clean_markup(t):
    return t.channel_messages.select("event_id", M.clean_markup(F.col("body")).alias("clean"))


ORDER_SQL = r"NULLIF(UPPER(REGEXP_EXTRACT({}, '(US|CA|GB)-\d{{6,}}(-WR)?', 0, 'i')), '')"


@case("extract_order_no", f"SELECT event_id, {ORDER_SQL.format('body')} AS order_number FROM channel_messages")
def extract_order_no(t):
    return t.channel_messages.select("event_id", M.order_number(F.col("body")).alias("order_number"))


@case("extract_sku", r"""
    SELECT event_id, COALESCE(NULLIF(UPPER(REGEXP_EXTRACT(body, '\bA-SKU-\d{3,}\b', 0, 'i')), ''),
                              NULLIF(REGEXP_EXTRACT(body, '\b\d{8}\b', 0), '')) AS sku
    FROM channel_messages""")
def extract_sku(t):
    return t.channel_messages.select("event_id", M.item_code(F.col("body")).alias("sku"))


@case("extract_facility", rf"""
    SELECT event_id, NULLIF(UPPER(REGEXP_EXTRACT(body, '\b{alternatives(config.FACILITY_CODES)}\b', 0, 'i')), '')
           AS facility FROM channel_messages""")
def extract_facility(t):
    return t.channel_messages.select("event_id", M.facility_code(F.col("body")).alias("facility"))


def question_sql(body: str) -> str:
    low = f"TRIM(LOWER({body}))"
    return rf"""({low} <> '' AND (contains({low}, '?') OR {starts_any(low, config.QUESTION_OPENERS)}
        OR REGEXP_MATCHES({body}, '(US|CA|GB)-\d{{6,}}', 'i') OR REGEXP_MATCHES({body}, '\b\d{{8,}}\b')
        OR (REGEXP_MATCHES({body}, '\b[A-Z0-9]{{8,}}\b') AND {contains_any(low, config.ORDER_WORDS)})
        OR {contains_any(low, config.TICKET_PHRASES)}))"""


ALL_TEXT_SQL = """
    SELECT 'channel' AS kind, event_id AS id, body FROM channel_messages
    UNION ALL SELECT 'document', doc_id, text FROM documents"""


def all_text(t):
    """Channel messages and whole documents, so that long natural text is classified too."""
    return t.channel_messages.select(
        F.lit("channel").alias("kind"), F.col("event_id").alias("id"), "body"
    ).unionByName(t.documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")
    ))


@case("classify_question", f"SELECT kind, id, {question_sql('body')} AS is_question FROM ({ALL_TEXT_SQL})")
def classify_question(t):
    return all_text(t).select("kind", "id", M.is_question(F.col("body")).alias("is_question"))


def smalltalk_sql(body: str) -> str:
    low = f"TRIM(LOWER({body}))"
    quoted = ", ".join("'" + g.replace("'", "''") + "'" for g in config.GREETINGS)
    return rf"""CASE WHEN REGEXP_REPLACE({low}, '[!?]$', '') IN ({quoted}) THEN 'greeting'
        WHEN REGEXP_MATCHES({low}, '\b{alternatives(config.WELLBEING_PHRASES)}\b') THEN 'wellbeing'
        WHEN REGEXP_MATCHES({low}, '\b{alternatives(config.THANKS_PHRASES)}\b') THEN 'thanks'
        WHEN REGEXP_MATCHES({low}, '\b{alternatives(config.IDENTITY_PHRASES)}\b') THEN 'identity' END"""


@case("classify_smalltalk", f"SELECT event_id, {smalltalk_sql('body')} AS class FROM channel_messages")
def classify_smalltalk(t):
    return t.channel_messages.select("event_id", M.smalltalk_class(F.col("body")).alias("class"))


@case("parse_ticket", """
    SELECT event_id, order_number, order_value, order_type, issue, team, sender,
           'box ' || event_id || ' arrived late' AS details FROM tickets""")
def parse_ticket(t):
    return t.ticket_posts.select("event_id", *M.ticket_fields(F.col("body")))


@case("order_country_warranty", """
    SELECT DISTINCT order_number, SPLIT_PART(order_number, '-', 1) AS country,
           order_number LIKE '%-WR' AS warranty_return,
           REPLACE(order_number, '-WR', '') AS base_order FROM tickets""")
def order_country_warranty(t):
    order = F.col("order_number")
    return t.tickets.select("order_number").distinct().select(
        "order_number", M.order_country(order).alias("country"),
        M.is_warranty_return(order).alias("warranty_return"), M.base_order(order).alias("base_order"),
    )


@case("route_identifier", r"""
    WITH wanted AS (SELECT DISTINCT UPPER(TRIM(identifier)) AS identifier FROM retail_requests)
    SELECT identifier,
           CASE WHEN REGEXP_MATCHES(identifier, '^[A-Z]{2}-') THEN 'delivery_orders.order_number'
                WHEN TRY_CAST(identifier AS BIGINT) IS NOT NULL THEN 'retail_order_lines.order_number'
                WHEN identifier <> '?' THEN 'retail_order_lines.customer_po_number' END AS route
    FROM wanted""")
def route_identifier(t):
    return L.routed(t.retail_requests)


@case("retail_lookup", """
    SELECT r.customer_po_number AS identifier, 'retail_order_lines.customer_po_number' AS route,
           r.customer_po_number, r.party_name, r.item_number, r.item_description, r.ordered_qty,
           r.shipped_quantity, CAST(r.unit_selling_price AS DOUBLE) AS unit_selling_price,
           r.status_code, r.ordered_date, r.ship_date
    FROM retail_order_lines r
    UNION ALL
    SELECT CAST(r.order_number AS VARCHAR), 'retail_order_lines.order_number', r.customer_po_number,
           r.party_name, r.item_number, r.item_description, r.ordered_qty, r.shipped_quantity,
           CAST(r.unit_selling_price AS DOUBLE), r.status_code, r.ordered_date, r.ship_date
    FROM retail_order_lines r JOIN orders o ON o.o_orderkey = r.order_number
    WHERE o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def retail_lookup(t):
    found = L.retail_lookup(t.retail_requests, t.retail_order_lines)
    return found.withColumn("unit_selling_price", F.col("unit_selling_price").cast("double"))


def topic_sql(body: str) -> str:
    low = f"LOWER({body})"
    branches = " ".join(
        f"WHEN {contains_any(low, words)} THEN '{table}'" for table, words in M.TOPIC_RULES
    )
    return f"CASE {branches} END"


@case("route_topic", f"SELECT kind, id, {topic_sql('body')} AS route FROM ({ALL_TEXT_SQL})")
def route_topic(t):
    return all_text(t).select("kind", "id", M.topic_route(F.col("body")).alias("route"))


def intent_sql(body: str) -> str:
    return f"""CASE WHEN {ORDER_SQL.format(body)} IS NOT NULL THEN 'order'
        WHEN {smalltalk_sql(body)} IS NOT NULL THEN 'smalltalk'
        WHEN {question_sql(body)} THEN 'data_question' ELSE 'ignore' END"""


@case("message_intent", f"SELECT event_id, {intent_sql('body')} AS intent FROM channel_messages")
def message_intent(t):
    return t.channel_messages.select("event_id", M.message_intent(F.col("body")).alias("intent"))
