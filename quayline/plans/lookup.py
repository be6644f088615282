"""Order lookup for a set of order numbers, with the source lines as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayline.functions import messages as M, scalars as S
from quayline.operators import relational as R
from quayline.plans.pipelines import delivery_orders


def shipments_by_token(shipments: DataFrame) -> DataFrame:
    """Shipments folded to the order token, which the lookup key names."""
    sets = {c: F.array_distinct(F.flatten(F.collect_set(F.split(c, ", ")))) for c in
            ("facilities", "carriers", "tracking_numbers")}
    return shipments.groupBy("order_token").agg(
        F.max("order_type").alias("shipment_order_type"),
        R.text_list(sets["facilities"]).alias("shipment_facilities"),
        R.text_list(sets["carriers"]).alias("shipment_carriers"),
        R.text_list(sets["tracking_numbers"]).alias("shipment_tracking"),
        F.min("first_ship_date").alias("shipment_first_ship_date"),
        F.sum("total_items").alias("shipment_items"),
        F.sum("total_std_cost").alias("shipment_cost"),
    )


def warranty_shipments(shipments: DataFrame) -> DataFrame:
    """The warranty shipments of each order token: when the first left, and their parcels."""
    kept = shipments.filter(F.contains("order_type", F.lit("WARRANTY")))
    return shipments_by_token(kept).select(
        "order_token", F.col("shipment_first_ship_date").alias("warranty_ship_date"),
        F.col("shipment_tracking").alias("warranty_tracking"),
    )


def order_shipment(orders: DataFrame, shipments: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Delivery orders and shipments side by side; either may be missing.

    `only` holds the order numbers to look at: both sides are cut down to them before anything is
    grouped or joined.
    """
    if only is not None:
        keys = only.select("order_number").distinct()
        orders = orders.join(keys, "order_number", "left_semi")
        shipments = shipments.join(keys.withColumnRenamed("order_number", "order_token"), "order_token", "left_semi")
    tokens = shipments_by_token(shipments)
    joined = orders.join(tokens, orders.order_number == tokens.order_token, "full")
    side = (
        F.when(F.col("order_token").isNull(), "delivery")
        .when(F.col("order_number").isNull(), "shipment")
        .otherwise("both")
    )
    return (
        joined.withColumn("found_in", side)
        .withColumn("order_number", F.coalesce("order_number", "order_token"))
        .drop("order_token")
    )


def candidate_numbers(requests: DataFrame, column: str = "order_number") -> DataFrame:
    """The numbers to try for each requested order: as given, then without the warranty suffix."""
    asked = F.upper(M.stripped(F.col(column)))
    wanted = requests.select(asked.alias("requested")).filter(F.col("requested") != "").distinct()
    tries = F.array_distinct(F.array("requested", M.base_order(F.col("requested"))))
    return wanted.select("requested", F.posexplode(tries).alias("preference", "order_number"))


def curated_hits(candidates: DataFrame, orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """The candidates that a curated table holds, with both sides' columns; one partitioning, by order number."""
    keys = candidates.select("order_number").distinct()
    tokens = shipments_by_token(
        shipments.join(keys.withColumnRenamed("order_number", "order_token"), "order_token", "left_semi")
    )
    known = orders.join(keys, "order_number", "left_semi").withColumn("_known", F.lit(True))
    joined = candidates.join(known, "order_number", "left").join(
        tokens, F.col("order_number") == F.col("order_token"), "left"
    )
    side = F.when(F.col("order_token").isNull(), "delivery").when(F.col("_known").isNull(), "shipment").otherwise("both")
    return (
        joined.filter(F.col("_known").isNotNull() | F.col("order_token").isNotNull())
        .withColumns({"found_in": side, "source": F.lit("curated")})
        .drop("order_token", "_known")
    )


def curated_candidates(candidates: DataFrame, orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """The candidates that a curated table holds; the tables' keys alone tell."""
    keys = candidates.select("order_number").distinct()
    numbers = orders.select("order_number").join(keys, "order_number", "left_semi").unionByName(
        shipments.select(F.col("order_token").alias("order_number")).join(keys, "order_number", "left_semi")
    )
    return candidates.join(numbers, "order_number", "left_semi")


def recovered(candidates: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """Source lines, rolled up whole, of the requests that are not in `known`."""
    wanted = candidates.join(known.select("requested"), "requested", "left_anti")
    return (
        wanted.join(delivery_orders(lines, only=wanted), "order_number")
        .withColumns({"found_in": F.lit("delivery"), "source": F.lit("lines")})
    )


def lookup_fallback(
    requests: DataFrame, orders: DataFrame, shipments: DataFrame, lines: DataFrame
) -> DataFrame:
    """Curated hits first; source lines, rolled up whole, only for requests both tables miss.

    Every table is cut down to the numbers asked for before it is grouped or joined. Which requests
    are known takes the keys of the curated tables alone.
    """
    candidates = candidate_numbers(requests)
    known = curated_candidates(candidates, orders, shipments)
    hits = curated_hits(candidates, orders, shipments)
    return hits.unionByName(recovered(candidates, known, lines), allowMissingColumns=True)


def order_lookup(
    requests: DataFrame, orders: DataFrame, shipments: DataFrame, lines: DataFrame
) -> DataFrame:
    """The best hit of every requested order that is known anywhere.

    Which candidate of a request is the best one shows from keys alone, before rows are joined to it.
    """
    candidates = candidate_numbers(requests)
    known = curated_candidates(candidates, orders, shipments)
    best = [F.asc("preference")]
    hits = curated_hits(R.newest_per_key(known, ["requested"], best), orders, shipments)
    # One row of a number that a table holds twice; the rows are dealt by order number already.
    hits = R.newest_per_key(hits, ["order_number", "requested"], best)
    rest = R.newest_per_key(recovered(candidates, known, lines), ["requested"], best)
    return hits.unionByName(rest, allowMissingColumns=True).drop("preference")


def collapse_lines(lines: DataFrame) -> DataFrame:
    """One order from its lines: attributes of the newest line, distinct parcels and items."""
    newest = F.struct(
        F.coalesce("shipped_date", F.lit("0001-01-01").cast("date")), "tracking_number",
        "item_name", "quantity", "delivery_date",
    )
    attributes = F.struct("facility", "carrier_code", "shipped_date", "delivery_date")
    parcels = lines.groupBy("order_number", "tracking_number").agg(
        F.max(newest).alias("rank"),
        F.max_by(attributes, newest).alias("newest"),
        F.sort_array(F.collect_set("item_name")).alias("items"),
        F.count(F.lit(1)).alias("lines"),
    )
    return (
        parcels.groupBy("order_number")
        .agg(
            F.max_by("newest", "rank").alias("newest"),
            R.text_list(F.collect_list("tracking_number")).alias("tracking_numbers"),
            F.count("tracking_number").alias("shipment_count"),
            F.size(R.merged_set("items")).cast("bigint").alias("unique_skus"),
            F.sum("lines").alias("line_count"),
        )
        .select("order_number", "newest.*", "tracking_numbers", "shipment_count", "unique_skus",
                "line_count")
    )


def day_label(column: str) -> Column:
    return S.short_date(F.col(column).cast("string"))


def labelled(column: str, missing: str = "n/a") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def order_card(found: DataFrame) -> DataFrame:
    """One text summary per order."""
    full = F.concat_ws(
        "\n",
        F.concat(F.lit("*Order:* `"), "order_number", F.lit("`")),
        F.concat(F.lit("*Status:* "), labelled("order_status", "UNKNOWN")),
        F.concat(
            F.lit("*Ordered:* "), day_label("ordered_date"),
            F.lit(" → *Sent to WH:* "), day_label("sent_to_wh_date"),
            F.lit(" → *Shipped:* "), day_label("first_ship_date"),
            F.lit(" → *Delivered:* "), day_label("last_delivery_date"),
        ),
        F.concat(F.lit("*Facility:* "), labelled("facilities")),
        F.concat(
            F.lit("*Carrier:* "), labelled("carriers"),
            F.lit(" | *Method:* "), labelled("shipping_method"),
        ),
        F.concat(F.lit("*Tracking:* "), labelled("tracking_numbers")),
        F.concat(
            F.lit("*Items:* "), labelled("unique_skus", "?"), F.lit(" SKUs, "),
            labelled("total_items", "?"), F.lit(" items across "),
            labelled("shipment_count", "?"), F.lit(" shipments"),
        ),
        F.concat(F.lit("*Ship to:* "), S.ship_to(F.col("city"), F.col("state"))),
    )
    if "found_in" in found.columns:
        short = F.concat(
            F.lit("*Order:* `"), "order_number",
            F.lit("`\n*Shipment data only (no delivery tracking)*"),
        )
        full = F.when(F.col("found_in") == "shipment", short).otherwise(full)
    return found.withColumn("card", full)


NOT_FOUND_REASONS = [
    "Order was placed very recently and hasn't reached the warehouse yet",
    "Order number may be incorrect — please verify",
    "This may be a *return order* (not an outbound shipment)",
    "For BOPIS orders, this channel cannot assist — please contact the retail team",
]


def order_not_found(requests: DataFrame, found: DataFrame) -> DataFrame:
    """The requested orders that no table knows, with the possible reasons."""
    wanted = candidate_numbers(requests).select("requested").distinct()
    return wanted.join(found, "requested", "left_anti").withColumn(
        "reasons", F.lit("\n".join(NOT_FOUND_REASONS))
    )


RETAIL_ANSWER = [
    "customer_po_number", "party_name", "item_number", "item_description", "ordered_qty",
    "shipped_quantity", "unit_selling_price", "status_code", "ordered_date", "ship_date",
]


def routed(identifiers: DataFrame, column: str = "identifier") -> DataFrame:
    """Each distinct identifier with the table and column it belongs to."""
    cleaned = F.upper(M.stripped(F.col(column)))
    return (
        identifiers.select(cleaned.alias("identifier")).distinct()
        .withColumn("route", M.identifier_route(F.col("identifier")))
    )


def retail_lookup(identifiers: DataFrame, lines: DataFrame) -> DataFrame:
    """Retail lines of customer PO numbers and of plain order numbers, one join per route."""
    wanted = routed(identifiers)

    def hits(column: str) -> DataFrame:
        mine = wanted.filter(F.col("route") == f"retail_order_lines.{column}")
        key = F.col("identifier").try_cast(lines.schema[column].dataType)
        return mine.withColumn("_key", key).join(lines, F.col("_key") == lines[column])

    answer = ["identifier", "route", *RETAIL_ANSWER]
    return hits("customer_po_number").select(*answer).unionByName(hits("order_number").select(*answer))
