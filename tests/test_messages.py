import pytest
from pyspark.sql import functions as F

from quayline import config
from quayline.functions import messages as M


def apply(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, expected", [
    ("is it here?", True), ("how many units", True), ("  How many", True), ("how", False), ("how ", False),
    ("somehow many", False), ("look upstairs", True), ("got US-123456 today", True), ("us-12345 only", False),
    ("number 12345678", True), ("number 1234567", False), ("WM123456 shipped", True), ("WM123456 arrived", False),
    ("wm123456 shipped", False), ("my refund", True), ("", False), ("   ", False), (None, False),
    ("the quantity at the facility", False), ("breakdowns happen", True), ("\twhich one", True),
])
def test_is_question(spark, text, expected):
    assert apply(spark, M.is_question, text) is expected


@pytest.mark.parametrize("opener", config.QUESTION_OPENERS)
def test_every_opener(spark, opener):
    assert apply(spark, M.is_question, f"{opener}x") is True
    assert apply(spark, M.is_question, f"zz{opener}x") is False


@pytest.mark.parametrize("phrase", config.TICKET_PHRASES)
def test_every_ticket_phrase(spark, phrase):
    assert apply(spark, M.is_question, f"a {phrase.upper()} here") is True


@pytest.mark.parametrize("text, expected", [
    ("hi", "greeting"), ("Hello!", "greeting"), ("<@U123> hey?", "greeting"), ("hi there", None),
    ("so how are you today", "wellbeing"), ("ty", "thanks"), ("many thanks", "thanks"), ("help", "identity"),
    ("the facility quantity", None), ("helpful", None), ("who are you", "identity"), ("", None),
])
def test_smalltalk(spark, text, expected):
    assert apply(spark, M.smalltalk_class, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("thanks, US-123456 came", "order"), ("thanks", "smalltalk"), ("which item", "data_question"), ("lunch", "ignore"),
])
def test_intent(spark, text, expected):
    assert apply(spark, M.message_intent, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("order us-1234567-wr now", "US-1234567-WR"), ("GB-123456", "GB-123456"), ("US-12345", None), ("", None),
])
def test_order_number(spark, text, expected):
    assert apply(spark, M.order_number, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("a-sku-0665 or 12345678", "A-SKU-0665"), ("item 12345678", "12345678"), ("123456789", None), ("A-SKU-12", None),
])
def test_item_code(spark, text, expected):
    assert apply(spark, M.item_code, text) == expected


def test_facility_code(spark):
    assert apply(spark, M.facility_code, "stock at imc") == "IMC"
    assert apply(spark, M.facility_code, "imcx") is None


@pytest.mark.parametrize("text, expected", [
    ("> _*hello*_", "hello"), ("_a_", "a"), ("*b* c", "b* c"), ("plain", "plain"),
])
def test_clean_markup(spark, text, expected):
    assert apply(spark, M.clean_markup, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("US-373216476", "delivery_orders.order_number"), ("us-373216476-wr", "delivery_orders.order_number"),
    ("14RDFC7K", "retail_order_lines.customer_po_number"), ("WM-12345", "retail_order_lines.customer_po_number"),
    ("18227968", "retail_order_lines.order_number"), ("?", None), ("", None),
])
def test_identifier_route(spark, text, expected):
    assert apply(spark, M.identifier_route, text) == expected


DUMP = """## Tool: read
preamble
### Message from a (ts: 1712345678.1234)
user: @alice
subtype: bot_message
reply_count: 3
thread_ts: 1
reactions: eyes
  where is it?

 second
(ts: 5.5) ### odd header
user: no handle
words (ts: 1.0) stay
### Third (ts: 7.25)
last words messages_requested: 3
not this
### Fourth (ts: 8)
nor this"""


def test_transcript(spark):
    rows = apply(spark, M.transcript_messages, DUMP)
    assert [tuple(r) for r in rows] == [
        ("1712345678.1234", "alice", "bot_message", 3, "where is it? second"),
        ("5.5", "", None, 0, "user: no handle words (ts: 1.0) stay"),
        ("7.25", "", None, 0, ""),
    ]


def test_transcript_without_messages(spark):
    assert apply(spark, M.transcript_messages, "nothing here") == []
    assert apply(spark, M.transcript_messages, "") == []
    stopped_early = "Showing only recent\n### One (ts: 1.5)\nhello"
    assert [r["body"] for r in apply(spark, M.transcript_messages, stopped_early)] == ["hello"]


def test_ticket_fields(spark):
    body = "*Order Number:* US-1\n*Issue:*  Late Delivery \n*Details:*\n*Team:* A *B*"
    row = spark.createDataFrame([(body,)], "t string").select(*M.ticket_fields(F.col("t"))).first()
    assert (row.order_number, row.issue, row.details, row.team) == ("US-1", "Late Delivery", None, "A *B*")
    assert row.sender is None


TOPICS = {
    "Which facility shipped the most units last week?": "delivery_orders",
    "orders by facility for Walmart": "delivery_orders",
    "What did Best Buy pay for this item": "retail_order_lines",
    "amazon shipments and list price": "retail_order_lines",
    "the SKU price of item 12": "item_master",
    "price for a customer": "retail_order_lines",
    "Walmart exceptions this week": "retail_order_exceptions",
    "shipment volume of a SKU": "outbound_lines",
    "units shipped of a SKU": "outbound_lines",
    "which facility has the most inventory": "inventory_eod",
    "where is my order": "delivery_orders",
    "good morning": None,
    "": None,
}


def test_topics_follow_the_routing_rules(spark):
    rows = spark.createDataFrame([(text,) for text in [*TOPICS, None]], "body string")
    found = {r.body: r.route for r in rows.select("body", M.topic_route(F.col("body")).alias("route")).collect()}
    assert found == TOPICS | {None: None}
