"""The curated tables, each a function from source DataFrames to a DataFrame.

`sources.tables.full_refresh` adds the sync stamp, lays the rows out and writes them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from quayline import config
from quayline.functions import scalars as S
from quayline.operators import relational as R
from quayline.sources.tables import Job

# name -> (function, names of the tables it needs first)
PIPELINES: dict[str, tuple[Callable, list[str]]] = {}


def pipeline(name: str, needs: tuple[str, ...] = ()):
    def register(build: Callable) -> Callable:
        PIPELINES[name] = (build, list(needs))
        return build

    return register


#: How the rows of a refreshed table are laid out.
LAYOUTS = {
    "products": ["item_number"], "po_lines": ["po_number", "po_line_number"], "inventory_eod": ["snapshot_date", "facility"],
    "goods_receipts": ["adjustment_date", "facility_id", "item_code"], "delivery_orders": ["order_number"],
    "shipments": ["order_token"],
}

#: Tables whose rows are shuffled to be made; a refresh writes them once before it lays them out.
MADE_FIRST = {"delivery_orders", "shipments"}


def refresh_jobs(folder: str, sources: dict[str, Callable[[], tuple]]) -> list[Job]:
    """A job for each curated table below `folder`, after the jobs it needs; `sources` gives each one's arguments."""
    done: dict[str, Job] = {}

    def add(name: str) -> None:
        if name not in done:
            build, needs = PIPELINES[name]
            for need in needs:
                add(need)
            done[name] = Job(
                name, lambda: build(*sources[name]()), f"{folder}/{name}", LAYOUTS[name], needs, name in MADE_FIRST
            )

    for name in PIPELINES:
        add(name)
    return list(done.values())


PACKAGING_RENAMES = {"serialized_item": "pkg_serialized_item", "coo": "pkg_coo"}


@pipeline("products")
def products_current(revisions: DataFrame, packaging: DataFrame) -> DataFrame:
    """The newest revision of each item with its current packaging version."""
    known = revisions.filter(F.col("item_number").isNotNull())
    newest = R.newest_per_key(
        known, ["item_number"], [F.desc_nulls_last("updated_at"), F.desc("id")]
    )
    versions = packaging.filter(F.col("valid_to").isNull())
    carried = [c for c in packaging.columns if c not in ("sku", "valid_to", "valid_from", "version_id")]
    current = versions.select(
        F.col("sku"), *[F.col(c).alias(PACKAGING_RENAMES.get(c, c)) for c in carried]
    )
    joined = newest.join(current, newest.item_number == current.sku, "left").drop("sku")
    return joined.withColumnRenamed("id", "product_id")


@pipeline("po_lines")
def po_lines(details: DataFrame) -> DataFrame:
    return details.select(*config.PO_COLUMNS)


PRODUCT_ATTRIBUTES = {
    "product_family": "product_family", "item_name": "product_name",
    "lifecycle_phase": "lifecycle_phase", "product_category": "product_category",
}


@pipeline("inventory_eod", needs=("products",))
def inventory_eod(
    onhand: DataFrame, products: DataFrame, as_of: date, days: int = 90
) -> DataFrame:
    """The on-hand snapshots of the last days with product attributes."""
    recent = onhand.filter(F.col("snapshot_date") >= F.date_sub(S.as_date(as_of), days))
    attributes = products.select(
        "item_number", *[F.col(c).alias(n) for c, n in PRODUCT_ATTRIBUTES.items()]
    )
    return recent.join(
        attributes, recent.item_code == attributes.item_number, "left"
    ).drop("item_number")


@pipeline("goods_receipts")
def goods_receipts(
    source: DataFrame,
    tenants: list[str],
    facilities: list[str],
    remark: str = config.RECEIPT_REMARK,
    as_of: date | None = None,
    lookback_days: int | None = None,
) -> DataFrame:
    """Booked receipts of the given tenants and facilities; all history without a lookback."""
    kept = source.filter(
        F.col("tenant").isin(tenants)
        & F.col("facility_id").isin(facilities)
        & (F.col("remarks") == remark)
    )
    if lookback_days is not None:
        kept = kept.filter(
            F.col("adjustment_date") >= F.date_sub(S.as_date(as_of), lookback_days)
        )
    measures = config.RECEIPT_INTEGERS + config.RECEIPT_AMOUNTS
    columns = []
    for name in config.RECEIPT_COLUMNS:
        if name == "adjustment_date":
            columns.append(S.date_text(F.col(name)).alias(name))
        elif name in measures:
            columns.append(S.zero_if_null(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return kept.select(*columns)


def order_status(cancelled: Column, all_delivered: Column, any_delivered: Column,
                 shipped: Column, sent: Column) -> Column:
    """The six order states; the first that applies wins."""
    return (
        F.when(cancelled == "Y", "CANCELLED")
        .when(all_delivered, "DELIVERED")
        .when(any_delivered, "PARTIALLY_DELIVERED")
        .when(shipped.isNotNull(), "SHIPPED")
        .when(sent.isNotNull(), "AT_WAREHOUSE")
        .otherwise("ORDERED")
    )


DELIVERY_ATTRIBUTES = [
    "source_order_number", "customer_name", "country", "state", "city", "shipping_method",
    "order_type", "is_split_order", "estimated_delivery_date", "delivery_status",
    "cancelled_flag", "processing_days", "transit_days", "days_to_delivery",
]


def folded(
    lines: DataFrame, keys: list[str], sets: dict[str, str], values: dict[str, Column],
    only: DataFrame | None = None,
) -> DataFrame:
    """Fold lines to their keys: sets of values (`sets`), the tracking numbers, and further aggregates.

    All keys take the same one step, combined before its shuffle: an order leaves each task as one row,
    so one with very many lines spreads over many tasks, and each value of it leaves a task once.
    `only` holds the keys to keep; lines of others go before anything is grouped.
    """
    if only is not None:
        lines = R.among(lines, keys[0], only)
    return lines.groupBy(*keys).agg(
        *[value.alias(name) for name, value in values.items()],
        *[F.collect_set(source).alias(name) for name, source in (sets | {"tracking": "tracking_number"}).items()],
    )


def counted(values: str) -> Column:
    return F.size(values).cast("bigint")


@pipeline("delivery_orders")
def delivery_orders(lines: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row per order from its delivery lines; of the orders in `only` if it is given."""
    delivered = F.coalesce(F.col("is_delivered"), F.lit(False))
    attributes = {c: F.max(c) for c in DELIVERY_ATTRIBUTES}
    orders = folded(
        lines,
        ["order_number"],
        {"facilities": "facility", "carriers": "carrier_code", "items": "item_name"},
        attributes | {
            "ordered": F.min("ordered_date"),
            "sent": F.min("sent_to_warehouse_date"),
            "first_shipped": F.min("shipped_date"),
            "last_shipped": F.max("shipped_date"),
            "first_delivered": F.min("delivery_date"),
            "last_delivered": F.max("delivery_date"),
            "total_items": F.sum("quantity"),
            "all_delivered": F.bool_and(delivered),
            "any_delivered": F.bool_or(delivered),
        },
        only,
    )
    status = order_status(
        F.col("cancelled_flag"), F.col("all_delivered"), F.col("any_delivered"),
        F.col("last_shipped"), F.col("sent"),
    )
    return orders.select(
        "order_number", "source_order_number", "customer_name", "country", "state", "city",
        R.text_list(F.col("facilities")).alias("facilities"),
        R.text_list(F.col("carriers")).alias("carriers"),
        "shipping_method", "order_type", "is_split_order",
        F.col("ordered").cast("date").alias("ordered_date"),
        F.col("sent").cast("date").alias("sent_to_wh_date"),
        F.col("first_shipped").cast("date").alias("first_ship_date"),
        F.col("last_shipped").cast("date").alias("last_ship_date"),
        F.col("first_delivered").cast("date").alias("first_delivery_date"),
        F.col("last_delivered").cast("date").alias("last_delivery_date"),
        "estimated_delivery_date",
        counted("items").alias("unique_skus"),
        "total_items",
        counted("tracking").alias("shipment_count"),
        R.text_list(F.col("tracking")).alias("tracking_numbers"),
        "delivery_status",
        status.alias("order_status"),
        "processing_days", "transit_days", "days_to_delivery",
    )


SHIPMENT_ATTRIBUTES = [
    "order_type_code", "order_type_name", "eff_order_type", "sales_channel", "country",
    "ship_to_name", "ship_method", "client_code", "product_name", "process_flag", "is_expedited",
]


@pipeline("shipments")
def shipments(lines: DataFrame, as_of: date, years: int = 2) -> DataFrame:
    """One row per order token and internal order number over the last years."""
    recent = lines.filter(
        F.col("shipping_date") >= S.shift_date(S.as_date(as_of), years=-years)
    )
    attributes = {c: F.max(c) for c in SHIPMENT_ATTRIBUTES}
    orders = folded(
        recent,
        ["order_token", "order_number"],
        {"facilities": "facility_id", "carriers": "carrier_code", "items": "item_code",
         "serials": "serial_number"},
        attributes | {
            "first_ship_date": F.min("shipping_date"),
            "last_ship_date": F.max("shipping_date"),
            "total_items": F.sum("quantity"),
            "total_packages": F.sum("number_packages"),
            "cost": F.sum("std_cost"),
        },
    )
    return orders.select(
        "order_token",
        F.col("order_number").alias("internal_order_number"),
        F.col("order_type_code").alias("order_type"),
        "order_type_name", "eff_order_type", "sales_channel", "country", "ship_to_name",
        R.text_list(F.col("facilities")).alias("facilities"),
        R.text_list(F.col("carriers")).alias("carriers"),
        "ship_method", "first_ship_date", "last_ship_date",
        counted("items").alias("unique_skus"),
        "total_items",
        counted("tracking").alias("shipment_count"),
        R.text_list(F.col("tracking")).alias("tracking_numbers"),
        "total_packages",
        F.col("cost").cast("double").alias("total_std_cost"),
        counted("serials").alias("serial_count"),
        "client_code", "product_name", "process_flag", "is_expedited",
    )


def receipts_7d(receipts: DataFrame, as_of: date) -> DataFrame:
    """Receipts of the last seven calendar days by date, facility and item."""
    keys = ["adjustment_date", "facility_id", "item_code", "item_description", "product_name"]
    return (
        receipts.filter(R.half_open_days("adjustment_date", as_of, 7))
        .groupBy(*keys)
        .agg(*[
            S.zero_if_null(F.sum(c)).alias(c) for c in ("avl_quantity", "unavl_quantity")
        ])
        .withColumn("adjustment_date", S.date_text(F.col("adjustment_date")))
        .orderBy(*keys)
    )


def all_inbound(home: DataFrame, other: DataFrame, home_region: str = "NA") -> DataFrame:
    """Both regional inbound feeds in one layout; a feed without a column leaves it null."""
    first = home.select(
        S.date_text(F.col("adjustment_date")).alias("inbound_date"),
        F.col("facility_id").alias("facility"),
        F.col("item_code").alias("sku"),
        "item_description",
        F.lit(home_region).alias("region"),
        "avl_quantity",
    )
    second = other.select(
        S.date_text(F.col("arrival_date")).alias("inbound_date"),
        "facility", "sku", "region", "received_quantity",
    )
    return first.unionByName(second, allowMissingColumns=True)


def inbound_discrepancies(shipped: DataFrame, received: DataFrame) -> DataFrame:
    """Shipped against received quantity per document date and item.

    One pass of signed rows and one aggregation replaces a join of two aggregates.
    """
    keys = ["doc_date", "item_code"]
    none = F.lit(None).cast("bigint")
    moved = shipped.select(
        *keys, F.col("quantity").alias("shipped_qty"), none.alias("received_qty")
    ).unionByName(
        received.select(*keys, none.alias("shipped_qty"), F.col("quantity").alias("received_qty"))
    )
    totals = moved.groupBy(*keys).agg(
        F.sum("shipped_qty").alias("shipped_qty"), F.sum("received_qty").alias("received_qty")
    )
    variance = S.zero_if_null(F.col("received_qty")) - S.zero_if_null(F.col("shipped_qty"))
    kind = (
        F.when(F.col("shipped_qty").isNull(), "NOT_SHIPPED")
        .when(F.col("received_qty").isNull(), "NOT_RECEIVED")
        .when(variance < 0, "SHORT")
        .when(variance > 0, "OVER")
        .otherwise("MATCH")
    )
    return totals.withColumn("variance", variance).withColumn("discrepancy_type", kind)


def age_risk(product_type: Column, months: Column) -> Column:
    """The risk class of an age under the limits of its product type."""
    ladder = F.when(months.isNull(), "Unknown")
    for kind, limits in config.AGE_LIMITS.items():
        for limit, risk in zip(limits, config.RISK_NAMES):
            ladder = ladder.when((product_type == kind) & (months <= limit), risk)
        ladder = ladder.when(product_type == kind, config.RISK_NAMES[-1])
    return ladder.otherwise("Unknown")


def age_band(product_type: Column, months: Column) -> Column:
    ladder = F.when(months.isNull(), "Unknown")
    for kind, limits in config.AGE_LIMITS.items():
        low = 0
        for limit in limits:
            ladder = ladder.when(
                (product_type == kind) & (months <= limit), f"{low}-{limit} months"
            )
            low = limit
        ladder = ladder.when(product_type == kind, f">{limits[-1]} months")
    return ladder.otherwise("Unknown")


def inventory_aging(lots: DataFrame) -> DataFrame:
    """Stock lots with age, age band, risk class and value."""
    months = S.age_months(F.col("receive_date"), F.col("snapshot_date"))
    aged = lots.withColumn("_months", months)
    return aged.select(
        *lots.columns,
        F.round("_months", 2).alias("age_months"),
        age_band(F.col("product_type"), F.col("_months")).alias("age_band"),
        age_risk(F.col("product_type"), F.col("_months")).alias("risk_category"),
        (F.col("quantity") * F.col("unit_cost_usd")).cast("double").alias("onhand_value_usd"),
    )


def partner_onhand(stock: DataFrame) -> DataFrame:
    """Available and total stock of a partner per item and location."""
    return stock.groupBy("sku", "location").agg(
        F.sum("available").alias("avl"), F.sum("total").alias("total")
    )
