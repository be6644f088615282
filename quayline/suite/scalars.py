"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from quayline.functions import scalars as S
from quayline.suite.pipelines import MONTHS_SQL
from quayline.suite.registry import AS_OF, case


@case("fn_date_text", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_text FROM lineitem")
def fn_date_text(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.date_text(F.col("l_shipdate")).alias("ship_text"))


@case("fn_date_add", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS plus_days,
           CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS minus_years FROM orders""")
def fn_date_add(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", S.shift_date(day, days=30).alias("plus_days"),
        S.shift_date(day, years=-2).alias("minus_years"),
    )


@case("fn_date_diff", """
    SELECT order_number, item_code, tracking_number, CAST(DATE_DIFF('day', ordered_date, delivery_date) AS INTEGER) AS days
    FROM delivery_lines""")
def fn_date_diff(t):
    return t.delivery_lines.select(
        "order_number", "item_code", "tracking_number",
        F.datediff("delivery_date", "ordered_date").alias("days"),
    )


@case("fn_week_trunc", "SELECT o_orderkey, CAST(DATE_TRUNC('week', o_orderdate) AS DATE) AS week FROM orders")
def fn_week_trunc(t):
    return t.orders.select("o_orderkey", S.week_start(F.col("o_orderdate")).alias("week"))


@case("fn_short_date", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'n/a' WHEN '5-LOW' THEN 'next month'
        ELSE strftime(o_orderdate, '%b %-d') END AS label FROM orders""")
def fn_short_date(t):
    layout = {
        "1-URGENT": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "2-HIGH": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
        "3-MEDIUM": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        "5-LOW": F.lit("next month at the earliest"),
    }
    text = F.lit(None).cast("string")
    for priority, value in layout.items():
        text = F.when(F.col("o_orderpriority") == priority, value).otherwise(text)
    return t.orders.select("o_orderkey", S.short_date(text).alias("label"))


@case("fn_number_commas", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           FORMAT('{:,}', l_orderkey * 1000) AS whole, FORMAT('{:,.2f}', l_extendedprice) AS price,
           CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE FORMAT('{:,}', CAST(l_quantity AS BIGINT) * 100) END
               AS quantity
    FROM lineitem""")
def fn_number_commas(t):
    quantity = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint") * 100)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.number_label(F.col("l_orderkey") * 1000).alias("whole"),
        S.number_label(F.col("l_extendedprice"), 2).alias("price"),
        S.number_label(quantity).alias("quantity"),
    )


@case("fn_coalesce_zero", """
    SELECT adjustment_id, item_code, COALESCE(avl_quantity, 0) AS avl_quantity,
           COALESCE(return_quantity, 0) AS return_quantity FROM receipts_source""")
def fn_coalesce_zero(t):
    return t.receipts_source.select(
        "adjustment_id", "item_code",
        *[S.zero_if_null(F.col(c)).alias(c) for c in ("avl_quantity", "return_quantity")],
    )


@case("fn_round", """
    SELECT facility_id, CAST(ROUND(SUM(extended_cost), 1) AS DOUBLE) AS one_digit,
           CAST(ROUND(SUM(extended_cost), 2) AS DOUBLE) AS two_digits FROM goods_receipts GROUP BY facility_id""")
def fn_round(t):
    total = F.sum("extended_cost")
    return t.goods_receipts.groupBy("facility_id").agg(
        S.rounded(total, 1).alias("one_digit"), S.rounded(total, 2).alias("two_digits")
    )


@case("fn_safe_pct", """
    SELECT item_code, CASE WHEN SUM(unavl_quantity) > 0 THEN
               CAST(ROUND((SUM(avl_quantity) - SUM(unavl_quantity)) * 100.0 / SUM(unavl_quantity), 1) AS DOUBLE) END
               AS pct
    FROM goods_receipts GROUP BY item_code""")
def fn_safe_pct(t):
    return t.goods_receipts.groupBy("item_code").agg(
        S.percent_change(F.sum("avl_quantity"), F.sum("unavl_quantity")).alias("pct")
    )


@case("fn_ship_to", """
    SELECT order_number, item_code, tracking_number,
           CASE WHEN COALESCE(city, '') <> '' AND COALESCE(state, '') <> '' THEN city || ', ' || state
                WHEN COALESCE(city, '') <> '' THEN city WHEN COALESCE(state, '') <> '' THEN state
                ELSE 'n/a' END AS ship_to FROM delivery_lines""")
def fn_ship_to(t):
    return t.delivery_lines.select(
        "order_number", "item_code", "tracking_number",
        S.ship_to(F.col("city"), F.col("state")).alias("ship_to"),
    )


@case("fn_case_fold", """
    SELECT event_id, LOWER(TRIM(body, ' ')) AS folded, UPPER(author) AS upper_author FROM channel_messages""")
def fn_case_fold(t):
    return t.channel_messages.select(
        "event_id", S.case_fold(F.col("body")).alias("folded"), F.upper("author").alias("upper_author")
    )


@case("fn_truncate_label", """
    SELECT conv_id, turn, LEFT(text, 24) AS short, CASE WHEN LENGTH(text) > 60 THEN LEFT(text, 60) || '...'
        ELSE text END AS label FROM conversations""")
def fn_truncate_label(t):
    return t.conversations.select(
        "conv_id", "turn", S.cut(F.col("text"), 24).alias("short"), S.ellipsis(F.col("text"), 60).alias("label")
    )


@case("fn_date_phrase", """
    WITH spans AS (
        SELECT event_id, DATE '2000-06-30' AS today, CAST(DATE_TRUNC('week', DATE '2000-06-30') AS DATE) AS monday,
               CASE event_type WHEN 'error' THEN 'what came in yesterday' WHEN 'click' THEN 'shipped This Week'
                    WHEN 'view' THEN 'cancelled last week' WHEN 'signup' THEN 'past month' ELSE 'any' END AS phrase
        FROM events)
    SELECT event_id,
           CASE phrase WHEN 'what came in yesterday' THEN today - 1 WHEN 'shipped This Week' THEN monday
                WHEN 'cancelled last week' THEN monday - 7 WHEN 'past month' THEN today - 30 ELSE today - 7 END AS range_start,
           CASE phrase WHEN 'what came in yesterday' THEN today WHEN 'cancelled last week' THEN monday END AS range_end,
           phrase IN ('past month', 'any', 'cancelled last week') AS holds_last_friday
    FROM spans""")
def fn_date_phrase(t):
    phrases = {
        "error": "what came in yesterday", "click": "shipped This Week",
        "view": "cancelled last week", "signup": "past month",
    }
    phrase = F.lit("any")
    for kind, words in phrases.items():
        phrase = F.when(F.col("event_type") == kind, words).otherwise(phrase)
    span = S.phrase_range(phrase, S.as_date(AS_OF))
    friday = F.date_sub(S.as_date(AS_OF), 7)
    return t.events.select(
        "event_id", span.getField("start").alias("range_start"), span.getField("end").alias("range_end"),
        S.in_range(friday, span).alias("holds_last_friday"),
    )


@case("fn_age_months", f"""
    SELECT product_number, receive_date, warehouse, quantity,
           CAST(ROUND(CAST({MONTHS_SQL} AS DOUBLE), 4) AS DOUBLE) AS months
    FROM stock_lots""")
def fn_age_months(t):
    months = S.age_months(F.col("receive_date"), F.col("snapshot_date"))
    return t.stock_lots.select(
        "product_number", "receive_date", "warehouse", "quantity", F.round(months, 4).alias("months")
    )


@case("fn_business_days", """
    SELECT order_number, item_code, tracking_number,
           CAST(LEN(LIST_FILTER(GENERATE_SERIES(ordered_date + 1, delivery_date, INTERVAL 1 DAY),
                                lambda d: ISODOW(d) < 6)) AS INTEGER) AS days
    FROM delivery_lines""")
def fn_business_days(t):
    return t.delivery_lines.select(
        "order_number", "item_code", "tracking_number",
        S.business_days(F.col("ordered_date"), F.col("delivery_date")).alias("days"),
    )
