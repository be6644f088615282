"""Ticket and delivery rules as columns over orders and tickets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from quayline import config
from quayline.functions import messages as M, scalars as S
from quayline.operators import relational as R


def rule_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed rule list as a broadcast side; its size is the length of the list."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def issue_policy(tickets: DataFrame) -> DataFrame:
    """Add the policy of each issue; an unknown issue goes to manual review."""
    rules = rule_table(tickets, list(config.ISSUE_POLICIES.items()), "issue string, policy string")
    return tickets.join(rules, "issue", "left").withColumn(
        "policy", F.coalesce("policy", F.lit("manual_review"))
    )


def day_text(column: str) -> Column:
    return S.short_date(F.col(column).cast("string"))


def normal_transit(service: str = "shipping_method", order: str = "order_number") -> Column:
    """A sentence on the days that a service takes in the order's country; empty for an unknown service."""
    told = []
    places = [(code, country, days) for (code, country), days in config.SERVICE_LEVELS_ABROAD.items()]
    for code, country, (least, most) in [*places, *((c, None, v[:2]) for c, v in config.SERVICE_LEVELS.items())]:
        days = f"{least}-{most}" if least < most else str(most)
        own = F.col(service) == code
        if country:
            own &= M.order_country(F.col(order)) == country
        told.append(F.when(own, f" Normal transit for {code} is {days} days."))
    return F.coalesce(*told, F.lit(""))


def assessment(as_of: date) -> Column:
    """What the order data says about the ticket's issue; expects ticket, order and warranty columns."""
    today = S.as_date(as_of)
    issue, status = F.col("issue"), F.col("order_status")
    count = F.col("shipment_count").cast("string")
    ago = lambda column: F.datediff(today, F.col(column)).cast("string")
    done = status.isin("DELIVERED", "PARTIALLY_DELIVERED")
    manual = F.concat(F.lit("This issue type ("), issue, F.lit(") requires manual review."))
    missing_items = (
        F.when(
            (status == "DELIVERED") & (F.col("shipment_count") > 1),
            F.concat(F.lit("Order was split across "), count,
                     F.lit(" shipments. All shipments show as delivered. Seller may need to check all packages.")),
        )
        .when(status == "DELIVERED", F.lit("Order shows as delivered in one shipment."))
        .when(
            status == "PARTIALLY_DELIVERED",
            F.concat(F.lit("Order has "), count,
                     F.lit(" shipments but not all have been delivered yet.")),
        )
        .when(
            status == "SHIPPED",
            F.concat(F.lit("Order shipped on "), day_text("first_ship_date"),
                     F.lit(", currently in transit. Estimated delivery: "),
                     day_text("estimated_delivery_date"), F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Order has not shipped. Status: "), status, F.lit(".")))
    )
    late = (
        F.when(
            done,
            F.concat(
                F.lit("Order delivered on "), day_text("last_delivery_date"), F.lit(", "),
                F.datediff("last_delivery_date", "ordered_date").cast("string"),
                F.lit(" days after order. Transit was "),
                F.coalesce(F.col("transit_days").cast("string"), F.lit("n/a")), F.lit(" days."),
            ),
        )
        .when(
            F.col("first_ship_date").isNotNull() & (status != "CANCELLED"),
            F.concat(F.lit("Order shipped "), ago("first_ship_date"),
                     F.lit(" days ago, still in transit."), normal_transit()),
        )
        .otherwise(F.concat(F.lit("Order has not shipped. Status: "), status, F.lit(".")))
    )
    not_shipped = (
        F.when(
            status == "AT_WAREHOUSE",
            F.concat(F.lit("Order sent to warehouse on "), day_text("sent_to_wh_date"),
                     F.lit(" ("), ago("sent_to_wh_date"), F.lit(" days ago). Not yet shipped.")),
        )
        .when(
            F.col("first_ship_date").isNotNull() & (status != "CANCELLED"),
            F.concat(F.lit("Order actually shipped on "), day_text("first_ship_date"),
                     F.lit(". Tracking: "), F.coalesce("tracking_numbers", F.lit("n/a")),
                     F.lit(".")),
        )
        .when(
            status == "ORDERED",
            F.concat(F.lit("Order placed on "), day_text("ordered_date"),
                     F.lit(" but not yet sent to warehouse.")),
        )
        .otherwise(F.concat(F.lit("Order has not shipped. Status: "), status, F.lit(".")))
    )
    warranty = F.concat(F.lit("A warranty shipment left on "), day_text("warranty_ship_date"),
                        F.lit(". Tracking: "), F.coalesce("warranty_tracking", F.lit("n/a")), F.lit("."))
    not_found = F.lit("Order not found in delivery tracking data.")
    return (
        F.when(issue.isin(config.RETURN_ISSUES) & F.col("warranty_ship_date").isNotNull(), warranty)
        .when(F.col("policy") == "manual_review", manual)
        .when(status.isNull(), not_found)
        .when(issue == "Missing Items", missing_items)
        .when(issue == "Late Delivery", late)
        .when(issue == "Order Has Not Shipped", not_shipped)
        .otherwise(manual)
    )


def triage_assessment(
    tickets: DataFrame, orders: DataFrame, as_of: date, warranty: DataFrame | None = None
) -> DataFrame:
    """Tickets with their order's data and the assessment; warranty returns use the base order.

    `warranty` holds the warranty shipments by order token (`plans.lookup.warranty_shipments`), which
    tickets about returns report; without it they go to manual review.
    """
    keyed = issue_policy(tickets).withColumn("base_order", M.base_order(F.col("order_number")))
    facts = orders.withColumnRenamed("order_number", "base_order").drop(
        *[c for c in tickets.columns if c != "order_number"]
    )
    known = keyed.join(facts, "base_order", "left")
    if warranty is None:
        known = known.withColumns({
            "warranty_ship_date": F.lit(None).cast("date"), "warranty_tracking": F.lit(None).cast("string"),
        })
    else:
        known = known.join(warranty.withColumnRenamed("order_token", "base_order"), "base_order", "left")
    return known.withColumn("assessment", assessment(as_of))


def processing_band(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit(None))
        .when(days <= config.PROCESSING_NORMAL_DAYS, "normal")
        .when(days < config.PROCESSING_CRITICAL_DAYS, "warning")
        .otherwise("critical")
    )


def transit_band(orders: DataFrame, service: str = "shipping_method") -> DataFrame:
    """Add the expected days of the service in the order's country, whether twice that has passed, and the delay class."""
    rows = [(code, days, fast) for code, (_, days, fast) in config.SERVICE_LEVELS.items()]
    levels = rule_table(orders, rows, f"{service} string, expected_days int, expedited boolean")
    abroad = [
        F.when((F.col(service) == code) & (M.order_country(F.col("order_number")) == country), most)
        for (code, country), (_, most) in config.SERVICE_LEVELS_ABROAD.items()
    ]
    days = F.col("transit_days")
    limit = F.when(F.col("expedited"), config.EXPEDITED_DELAY_DAYS).otherwise(
        config.GROUND_DELAY_DAYS
    )
    band = (
        F.when(days.isNull(), F.lit(None))
        .when(days > config.OVERDUE_DAYS, "overdue")
        .when(days > 2 * F.col("expected_days"), "warning")
        .when(days > limit, "delayed")
        .otherwise("on_time")
    )
    return (
        orders.join(levels, service, "left")
        .withColumn("expected_days", F.coalesce(*abroad, "expected_days"))
        .withColumn("over_twice_expected", days > 2 * F.col("expected_days"))
        .withColumn("transit_band", band)
    )


def is_lost(as_of: date) -> Column:
    """Undelivered and at least ten business days past the estimated delivery."""
    late = S.business_days(F.col("estimated_delivery_date"), S.as_date(as_of))
    return F.coalesce(
        ~F.col("order_status").isin(config.CLOSED_ORDER_STATUSES)
        & (late >= config.LOST_AFTER_BUSINESS_DAYS),
        F.lit(False),
    )


def late_flags(orders: DataFrame, as_of: date, stuck_days: int = 3) -> DataFrame:
    no = F.lit(False)
    stuck = (F.col("order_status") == "AT_WAREHOUSE") & (
        F.datediff(S.as_date(as_of), F.col("sent_to_wh_date")) > stuck_days
    )
    return (
        orders.withColumn(
            "shipped_late", F.coalesce(F.col("processing_days") > config.LATE_SHIP_DAYS, no)
        )
        .withColumn(
            "delivered_late", F.coalesce(F.col("transit_days") > config.LATE_DELIVERY_DAYS, no)
        )
        .withColumn("stuck_at_warehouse", F.coalesce(stuck, no))
    )


def claim_window(orders: DataFrame, as_of: date) -> DataFrame:
    """For each order and carrier, the days on which a carrier claim may be filed."""
    rows = [(carrier, *rule) for carrier, rule in config.CLAIM_WINDOWS.items()]
    rules = rule_table(
        orders, rows, "carrier string, counted_from string, first_day int, last_day int"
    )
    start = F.when(F.col("counted_from") == "ship", F.col("first_ship_date")).otherwise(
        F.col("last_delivery_date")
    )
    return (
        orders.select(
            "order_number", "first_ship_date", "last_delivery_date",
            F.explode(F.split("carriers", ", ")).alias("carrier"),
        )
        .join(rules, "carrier", "left")
        .withColumn("opens_on", F.date_add(start, F.col("first_day")))
        .withColumn("closes_on", F.date_add(start, F.col("last_day")))
        .withColumn(
            "is_open",
            F.coalesce(S.as_date(as_of).between(F.col("opens_on"), F.col("closes_on")), F.lit(False)),
        )
        .drop("counted_from", "first_day", "last_day")
    )


def replacement_eligibility(as_of: date) -> Column:
    delivered = F.col("last_delivery_date")
    return (
        F.when(delivered.isNull(), "not_delivered")
        .when(F.datediff(S.as_date(as_of), delivered) > config.REPLACEMENT_DAYS, "limited")
        .otherwise("eligible")
    )


def address_change_rule(status: Column) -> Column:
    return (
        F.when(status.isin("SHIPPED", "PARTIALLY_DELIVERED", "DELIVERED"), "refused")
        .when(status.isin("ORDERED", "AT_WAREHOUSE"), "possible")
        .otherwise("not_applicable")
    )


def escalation_team(issue: Column, order: Column, order_type: Column) -> Column:
    """The team that takes a ticket; the first rule that applies wins."""
    low = F.lower(issue)
    return (
        F.when(low.contains("bopis"), "retail_team")
        .when(M.order_country(order) == "GB", "eu_apac_team")
        .when(low.contains("fraud"), "fraud_team")
        .when(low.contains("discount"), "refund_team")
        .when(M.is_warranty_return(order), "warranty_team")
        .when(
            (M.order_country(order) == "CA") & ((order_type == "Return") | low.contains("return")),
            "ca_returns_team",
        )
        .when(low.contains("address change"), "warehouse_team")
        .otherwise("delivery_help_desk")
    )


def duplicate_tickets(tickets: DataFrame) -> DataFrame:
    """Add the kind of each ticket: new, duplicate, escalation or warranty.

    A ticket within seven days of the order's previous one is a duplicate when its issue is the
    same and an escalation when it differs; warranty returns are never duplicates.
    """
    linked = R.with_previous(tickets, "order_number", "ts", "event_id", ["issue"])
    previous = F.col("previous")
    near = F.col("ts") <= previous.getField("ts") + F.expr(
        f"INTERVAL '{config.DUPLICATE_DAYS}' DAY"
    )
    kind = (
        F.when(M.is_warranty_return(F.col("order_number")), "warranty")
        .when(~F.coalesce(near, F.lit(False)), "new")
        .when(previous.getField("issue") == F.col("issue"), "duplicate")
        .otherwise("escalation")
    )
    return (
        linked.withColumn("previous_event_id", previous.getField("event_id"))
        .withColumn("ticket_kind", kind)
        .drop("previous")
    )


def mix(df: DataFrame, *keys: str) -> DataFrame:
    """Count and share of all rows for each key; the total adds up the counts, one row a key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("tickets"))
    total = counted.agg(F.sum("tickets")).scalar()
    return counted.withColumn("share_pct", S.share_percent(F.col("tickets"), total))
