"""Codes, word lists, thresholds and patterns the results depend on."""

from __future__ import annotations

# --- fixed values: facilities and receipts -----------------------------------------------------
FACILITY_CODES = ["CVU", "IMC", "IMU", "GBR", "NLD", "ARV", "SGU"]
RECEIPT_REMARK = "STAT"
RECEIPT_COLUMNS = [
    "adjustment_date", "facility_id", "item_code", "item_description", "product_name",
    "client_code", "adjustment_id", "avl_quantity", "unavl_quantity", "return_quantity",
    "std_cost", "extended_cost", "file_name", "process_flag",
]
RECEIPT_KEY = ["adjustment_date", "facility_id", "item_code", "adjustment_id"]
RECEIPT_INTEGERS = ["avl_quantity", "unavl_quantity", "return_quantity"]
RECEIPT_AMOUNTS = ["std_cost", "extended_cost"]
RECEIPT_HEADER_ALIASES = {"facility_id": ["FACILILTY_ID"]}
PO_COLUMNS = [
    "po_number", "po_line_number", "po_header_id", "item_id", "item_number", "supplier_name",
    "supplier_site", "warehouse", "po_header_status", "description", "po_line_qty",
    "po_line_status", "location_name", "procurement_bu", "destination_type_code",
    "requested_delivery_date", "po_apprvl_dt", "created_at", "updated_at",
]

# --- fixed values: statuses --------------------------------------------------------------------
RUN_STATUSES = ["running", "success", "error", "skipped"]
ACTIVE_PHASES = ["Released", "In Production"]
CLOSED_ORDER_STATUSES = ["DELIVERED", "CANCELLED"]

# --- fixed values: age bands, upper bounds in months per product type ---------------------------
AGE_LIMITS = {"1P": [3, 6, 12], "3P": [5, 8, 12]}
RISK_NAMES = ["Target", "Low Risk", "Medium Risk", "High Risk"]

# --- fixed values: identifiers in text ---------------------------------------------------------
ORDER_PATTERN = r"(?:US|CA|GB)-\d{6,}(?:-WR)?"
ORDER_PREFIX_PATTERN = r"(?:US|CA|GB)-\d{6,}"
ITEM_PATTERN = r"\bA-SKU-\d{3,}\b"
ITEM_NUMBER_PATTERN = r"\b\d{8}\b"
LONG_NUMBER_PATTERN = r"\b\d{8,}\b"
LONG_TOKEN_PATTERN = r"\b[A-Z0-9]{8,}\b"

# --- fixed values: message classes -------------------------------------------------------------
QUESTION_OPENERS = [
    "how ", "what ", "when ", "where ", "why ", "show ", "list ", "find ", "look up", "check ",
    "tell ", "give ", "get ", "pull ", "can you ", "is there", "are there", "do we ", "did we ",
    "has ", "have ", "which ", "who ", "compare ", "breakdown", "details ", "status ", "track ",
    "price ", "cost ",
]
ORDER_WORDS = ["order", "track", "status", "detail", "ship", "deliver"]
TICKET_PHRASES = [
    "missing item", "late delivery", "order not shipped", "address change", "return label",
    "return request", "replacement", "damaged", "wrong item", "not received", "lost package",
    "refund", "delivery issue", "order status", "tracking", "where is my",
]
GREETINGS = [
    "hi", "hey", "hello", "yo", "sup", "howdy", "heya", "hiya", "whats up", "what's up",
]
WELLBEING_PHRASES = [
    "how are you", "hows it going", "how's it going", "how you doing", "how's your day",
    "how are things", "what are you up to", "you good", "how goes it",
]
THANKS_PHRASES = [
    "thanks", "thank you", "thx", "ty", "appreciate it", "nice work", "good job", "great job",
    "well done",
]
IDENTITY_PHRASES = [
    "who are you", "what are you", "what do you do", "what can you do", "help",
]
SKIPPED_SUBTYPES = ["channel_join", "bot_message"]
TRANSCRIPT_SKIPPED_PREFIXES = [
    "reactions:", "files:", "  [", "## Tool", "messages_", "contains_", "min_", "max_", "total_",
    "has_more",
]
TRANSCRIPT_STOP_MARKERS = ["Showing only recent", "messages_requested"]

# --- fixed values: listener limits -------------------------------------------------------------
MESSAGE_MAX_AGE = "2 hours"
CHANNEL_QUOTA = 3
MENTION_QUOTA = 2
#: Seconds that a stream works with the channel settings it has read.
SETTINGS_SECONDS = 300
CHANNEL_DEFAULTS = {"escalation_cc": False, "disclaimer": False}
ANSWER_ROW_CAP = 50
HISTORY_ROWS = 20
RUN_ABANDONED_AFTER = "1 day"

# --- fixed values: ticket fields and issue policies --------------------------------------------
TICKET_FIELDS = {
    "order_number": "Order Number", "order_value": "Order Value", "order_type": "Order Type",
    "issue": "Issue", "team": "Team", "sender": "From", "details": "Details",
}
ISSUE_POLICIES = {
    "Missing Items": "lookup",
    "Late Delivery": "lookup",
    "Order Has Not Shipped": "lookup",
    "Address Change Request": "manual_review",
    "Return Delivered, But No Refund": "manual_review",
    "Return Not Delivered": "manual_review",
    "Damaged Order": "manual_review",
    "Wrong Items": "manual_review",
}

RETURN_ISSUES = ["Return Delivered, But No Refund", "Return Not Delivered"]

# --- fixed values: service levels --------------------------------------------------------------
# service code -> (least and longest expected business days, expedited)
SERVICE_LEVELS = {
    "GGRNDP": (3, 7, False), "G3DAYP": (3, 3, True), "G2DAYP": (2, 2, True), "GNXDYP": (1, 1, True),
}
# (service code, country) -> days that differ there
SERVICE_LEVELS_ABROAD = {("GGRNDP", "CA"): (3, 5)}
GROUND_DELAY_DAYS = 5
EXPEDITED_DELAY_DAYS = 3
OVERDUE_DAYS = 10
PROCESSING_NORMAL_DAYS = 2
PROCESSING_CRITICAL_DAYS = 5
LOST_AFTER_BUSINESS_DAYS = 10
LATE_SHIP_DAYS = 2
LATE_DELIVERY_DAYS = 5
REPLACEMENT_DAYS = 30
DUPLICATE_DAYS = 7
# carrier -> (counted from, first day, last day)
CLAIM_WINDOWS = {
    "usps": ("ship", 15, 60), "fedex": ("ship", 0, 60), "fedex-freight": ("ship", 0, 21),
    "ups": ("delivery", 0, 60), "purolator-v2": ("ship", 0, 30),
}
