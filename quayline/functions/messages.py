"""Column functions that read and classify message text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from quayline import config

UNICODE = "(?U)"


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def first_match(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """The first hit of a pattern, or null."""
    flags = "(?iU)" if ignore_case else UNICODE
    return F.nullif(F.regexp_extract(text, f"{flags}{pattern}", 0), F.lit(""))


def order_number(text: Column) -> Column:
    return F.upper(first_match(text, config.ORDER_PATTERN))


def item_code(text: Column) -> Column:
    return F.coalesce(
        F.upper(first_match(text, config.ITEM_PATTERN)),
        first_match(text, config.ITEM_NUMBER_PATTERN),
    )


def facility_code(text: Column, codes: list[str] = config.FACILITY_CODES) -> Column:
    return F.upper(first_match(text, rf"\b(?:{'|'.join(codes)})\b"))


def clean_markup(text: Column, bot: str | None = None) -> Column:
    """Text without the bot mention, a leading quote sign and surrounding italics and bold."""
    out = text
    if bot:
        out = F.replace(out, F.lit(f"<@{bot}>"), F.lit(""))
    out = F.regexp_replace(stripped(out), r"(?U)^>\s*", "")
    out = F.regexp_replace(stripped(out), r"^_|_$", "")
    out = F.regexp_replace(stripped(out), r"^\*|\*$", "")
    return stripped(out)


def strip_mentions(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"<@[A-Z0-9]+>", ""))


def opener_pattern() -> str:
    """Text that begins with an opener; one that ends in a space needs more text after it."""
    spaced = [w.rstrip() for w in config.QUESTION_OPENERS if w.endswith(" ")]
    bare = [w for w in config.QUESTION_OPENERS if not w.endswith(" ")]
    return rf"(?iU)^\s*(?:(?:{'|'.join(spaced)}) (?=\s*\S)|{'|'.join(bare)})"


def is_question(text: Column) -> Column:
    """Whether the message asks for an answer. Each word list is one pattern over the text."""
    asked = any_of([
        F.contains(text, F.lit("?")),
        text.rlike(opener_pattern()),
        text.rlike(f"(?iU){config.ORDER_PREFIX_PATTERN}"),
        text.rlike(UNICODE + config.LONG_NUMBER_PATTERN),
        text.rlike(UNICODE + config.LONG_TOKEN_PATTERN)
        & text.rlike(f"(?i){'|'.join(config.ORDER_WORDS)}"),
        text.rlike(f"(?i){'|'.join(config.TICKET_PHRASES)}"),
    ])
    return F.coalesce(asked, F.lit(False))


def has_phrase(low: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in the text as whole words."""
    return low.rlike(rf"(?U)(?<!\w)(?:{'|'.join(phrases)})(?!\w)")


def smalltalk_class(text: Column) -> Column:
    """greeting, wellbeing, thanks, identity, or null."""
    low = strip_mentions(F.lower(text))
    low = F.regexp_replace(low, r"(?U)^<@[a-z0-9]+>\s*", "")
    return (
        F.when(
            F.regexp_replace(low, "[!?]$", "").isin(config.GREETINGS), F.lit("greeting")
        )
        .when(has_phrase(low, config.WELLBEING_PHRASES), F.lit("wellbeing"))
        .when(has_phrase(low, config.THANKS_PHRASES), F.lit("thanks"))
        .when(has_phrase(low, config.IDENTITY_PHRASES), F.lit("identity"))
    )


def message_intent(text: Column, asked: Column | None = None) -> Column:
    """order, smalltalk, data_question or ignore; an order number always wins.

    `asked` tells whether the message is a question, by default judged from the same text.
    """
    asked = is_question(text) if asked is None else asked
    return (
        F.when(order_number(text).isNotNull(), F.lit("order"))
        .when(smalltalk_class(text).isNotNull(), F.lit("smalltalk"))
        .when(asked, F.lit("data_question"))
        .otherwise(F.lit("ignore"))
    )


def ticket_field(body: Column, label: str) -> Column:
    """The value after `*Label:*` on its line, or null."""
    found = F.regexp_extract(body, rf"(?m)^\*{label}:\*[ \t]*(.*)$", 1)
    return F.nullif(stripped(found), F.lit(""))


def ticket_fields(body: Column) -> list[Column]:
    return [ticket_field(body, label).alias(name) for name, label in config.TICKET_FIELDS.items()]


def order_country(order: Column) -> Column:
    prefix = F.upper(F.substring(order, 1, 2))
    return F.when(prefix.isin("US", "CA", "GB"), prefix)


def is_warranty_return(order: Column) -> Column:
    return F.upper(order).endswith("-WR")


def base_order(order: Column) -> Column:
    """The order number without its warranty suffix."""
    return F.regexp_replace(order, "(?i)-WR$", "")


def identifier_route(identifier: Column) -> Column:
    """Which key an identifier is: the delivery order, the retail order or the customer PO."""
    value = F.upper(stripped(identifier))
    return (
        F.when(value.rlike(r"^(US|CA|GB)-\d{6,}(-WR)?$"), F.lit("delivery_orders.order_number"))
        .when(value.rlike(r"^\d+$"), F.lit("retail_order_lines.order_number"))
        .when(
            value.rlike(r"^[A-Z0-9][A-Z0-9-]*$"), F.lit("retail_order_lines.customer_po_number")
        )
    )


# Customers whose name makes a question one about retail orders.
RETAIL_CUSTOMERS = ["amazon", "walmart", "best buy"]
# Tables with the words that lead to them; the first that a text holds wins. Orders counted by facility come
# from the order roll-up, whatever else is named; a customer's prices, orders and shipments from retail lines;
# prices and setup of a SKU from the item master; shipped volumes of a SKU from the shipment lines.
TOPIC_RULES = [
    ("delivery_orders", ["facility shipped", "facilities shipped", "orders per facility", "orders by facility"]),
    ("retail_order_exceptions", ["exception"]),
    ("retail_order_lines", RETAIL_CUSTOMERS),
    ("item_master", ["list price", "sku price", "sku setup"]),
    ("retail_order_lines", ["retail", "customer", "price", "revenue"]),
    ("inventory_aging", ["aging", "excess", "obsolete"]),
    ("inbound_discrepancies", ["discrepanc"]),
    ("all_inbound", ["inbound", "came in", "receipt", "arrived"]),
    ("inventory_eod", ["inventory", "on hand", "stock"]),
    ("outbound_lines", ["units shipped", "shipment volume", "shipped volume", "serial", "warranty"]),
    ("products", ["product family", "lifecycle", "active sku"]),
    ("delivery_orders", ["order", "deliver", "shipped", "transit", "track", "warehouse"]),
]


def topic_route(text: Column) -> Column:
    """The table that answers a question, by its topic words; null when none is named."""
    return F.coalesce(*[
        F.when(text.rlike(f"(?i){'|'.join(words)}"), F.lit(table)) for table, words in TOPIC_RULES
    ])


def transcript_messages(dump: Column) -> Column:
    """The messages of a text dump, as array<struct<ts, author, subtype, reply_count, body>>.

    A header line starts a message; metadata lines are left out; a tool summary ends the dump.
    """
    header = r"(?=[^\n]*###)(?=[^\n]*\(ts: [\d.]+\))"
    prefixes = [*config.TRANSCRIPT_SKIPPED_PREFIXES, "user: @", "subtype:", "reply_count:",
                "thread_ts:"]
    fenced = "|".join(rf"\Q{prefix}\E" for prefix in prefixes)
    markers = "|".join(rf"\Q{marker}\E" for marker in config.TRANSCRIPT_STOP_MARKERS)
    split = F.split(F.concat(F.lit("\n"), dump), rf"\n{header}")
    blocks = F.filter(split, lambda _, position: position > 0)
    stop_line = rf"\n(?!{fenced})[^\n]*(?:{markers})"

    def kept(blocks: Column) -> Column:
        stopped = F.array_position(F.transform(blocks, lambda b: b.rlike(stop_line)), F.lit(True))
        return F.filter(
            blocks, lambda _, position: (stopped == 0) | (position < stopped)
        )

    def last_value(block: Column, pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), F.lit(-1))

    def before_stop(block: Column) -> Column:
        return F.when(block.rlike(stop_line), F.regexp_replace(block, rf"(?s){stop_line}.*$", "")
                      ).otherwise(block)

    def message(whole: Column) -> Column:
        lines = F.split(whole, "\n")
        lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        spoken = F.filter(
            lines, lambda line: ~line.rlike(f"^(?:{fenced})") & (stripped(line) != "")
        )
        body = F.array_join(F.transform(spoken, stripped), " ")
        return F.struct(
            F.regexp_extract(whole, r"\(ts: ([\d.]+)\)", 1).alias("ts"),
            F.coalesce(last_value(whole, r"(?m)^user: @(\w+)"), F.lit("")).alias("author"),
            F.trim(last_value(whole, r"(?m)^subtype:(.*)$")).alias("subtype"),
            F.coalesce(
                F.trim(last_value(whole, r"(?m)^reply_count:(.*)$")).try_cast("int"), F.lit(0)
            ).alias("reply_count"),
            body.alias("body"),
        )

    # Wrapping the blocks in an array binds them to a name, so that the dump is split only once.
    once = F.transform(
        F.array(blocks), lambda found: F.transform(F.transform(kept(found), before_stop), message)
    )
    return F.flatten(once)
