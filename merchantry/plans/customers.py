"""Customer summaries, segments, places and behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.classify import customer_segment, lifetime_value_tier
from merchantry.functions.scalar import (
    MONEY,
    Moment,
    age_years,
    days_since,
    full_name,
    mean,
    mean_money,
    moment,
    money,
    normalised_email,
    percent,
    total,
    within_last,
    zero_if_null,
)
from merchantry.operators.aggregates import most_frequent
from merchantry.operators.joins import few
from merchantry.rules import Rules


def not_cancelled(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") != "cancelled")


def order_product_units(items: DataFrame) -> DataFrame:
    """Items at (order, product) grain. Combined before the shuffle, so that neither a huge
    order nor a product that is in every order gathers raw lines in one task."""
    return items.groupBy("order_id", "product_id").agg(
        F.sum("quantity").alias("units"), total(F.sum("total_price")).alias("revenue")
    )


def _profile() -> list[Column]:
    return [
        F.col("customer_id"),
        F.col("email").alias("customer_email"),
        full_name("first_name", "last_name").alias("customer_name"),
        F.col("phone").alias("customer_phone"),
        F.to_date("created_at").alias("customer_created_date"),
    ]


def _classified(summary: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    return (
        summary.withColumn("days_since_last_order", days_since("last_order_date", as_of))
        .withColumn("customer_segment", customer_segment(rules))
        .withColumn("lifetime_value_tier", lifetime_value_tier(rules))
        .withColumn("last_calculated_at", moment(as_of))
    )


def order_figures(per_order: DataFrame) -> DataFrame:
    """What a summary needs to know of each customer's orders; `per_order` holds one row per order,
    with `copies` = how often the order counts."""
    return per_order.groupBy("customer_id").agg(
        F.sum("copies").alias("total_orders"),
        F.sum(F.col("total_amount") * F.col("copies")).alias("spent"),
        # NULL totals count as orders but stay out of the average
        F.sum(F.when(F.col("total_amount").isNotNull(), F.col("copies"))).alias("priced"),
        F.min("total_amount").alias("lowest"),
        F.max("total_amount").alias("highest"),
        F.min("created_at").alias("first_order_date"),
        F.max("created_at").alias("last_order_date"),
        F.sum("units").alias("units"),
    )


def summary_of(customers: DataFrame, figures: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    """The summary of all customers from the figures of their orders."""
    joined = customers.select(*_profile()).join(figures, "customer_id", "left")
    summary = joined.select(
        "customer_id",
        "customer_email",
        "customer_name",
        "customer_phone",
        "customer_created_date",
        zero_if_null("total_orders").cast("bigint").alias("total_orders"),
        total(zero_if_null("spent")).alias("total_spent"),
        money(zero_if_null(mean_money("spent", "priced"))).alias("avg_order_value"),
        money(zero_if_null("lowest")).alias("min_order_value"),
        money(zero_if_null("highest")).alias("max_order_value"),
        "first_order_date",
        "last_order_date",
        zero_if_null("units").cast("bigint").alias("total_products_purchased"),
    )
    return _classified(summary, as_of, rules)


def orders_with_units(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items combined to order grain before they meet the orders: no fan-out, less to shuffle."""
    per_order = items.groupBy("order_id").agg(F.sum("quantity").alias("units"), F.count("*").alias("lines"))
    live = not_cancelled(orders).select("order_id", "customer_id", "total_amount", "created_at")
    return live.join(per_order, "order_id", "left")


def customer_order_summary(
    customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: Moment, rules: Rules
) -> DataFrame:
    """One row per customer over all orders that are not cancelled; zeros without orders."""
    per_order = orders_with_units(orders, items).withColumn("copies", F.lit(1).cast("bigint"))
    return summary_of(customers, order_figures(per_order), as_of, rules)


def customer_order_summary_line_grain(
    customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: Moment, rules: Rules
) -> DataFrame:
    """The summary as the published refresh computes it: every order counts once per line.

    Kept for comparing with existing reports; counts, sums and averages are inflated by
    orders with several lines. An order of n lines is weighted by n, which gives the same
    figures without building the n-fold rows.
    """
    per_order = orders_with_units(orders, items).withColumn(
        "copies", F.greatest(zero_if_null("lines"), F.lit(1)).cast("bigint")
    )
    return summary_of(customers, order_figures(per_order), as_of, rules)


def recent_customer_summary(
    customers: DataFrame, orders: DataFrame, as_of: Moment, rules: Rules, days: int = 30
) -> DataFrame:
    """Summary of customers created in the last `days` days, without items.

    As in the load job it comes from, the averages and extremes of a customer without
    orders stay NULL.
    """
    recent = customers.where(within_last("created_at", as_of, f"{days} days"))
    live, wanted = not_cancelled(orders), recent.select("customer_id")
    if few(wanted):  # then the orders of all others never leave the scan
        live = live.join(F.broadcast(wanted), "customer_id", "left_semi")
    per_customer = (
        live.groupBy("customer_id")
        .agg(
            F.count("order_id").alias("n"),
            F.sum("total_amount").alias("spent"),
            F.count("total_amount").alias("priced"),
            F.min("total_amount").alias("lowest"),
            F.max("total_amount").alias("highest"),
            F.min("created_at").alias("first_order_date"),
            F.max("created_at").alias("last_order_date"),
        )
    )
    joined = recent.select(*_profile()[:3]).join(per_customer, "customer_id", "left")
    summary = joined.select(
        "customer_id",
        "customer_email",
        "customer_name",
        zero_if_null("n").cast("bigint").alias("total_orders"),
        total(zero_if_null("spent")).alias("total_spent"),
        mean_money("spent", "priced").alias("avg_order_value"),
        F.col("lowest").cast(MONEY).alias("min_order_value"),
        F.col("highest").cast(MONEY).alias("max_order_value"),
        "first_order_date",
        "last_order_date",
    )
    return _classified(summary, as_of, rules).drop("lifetime_value_tier")


def customer_segment_distribution(summary: DataFrame) -> DataFrame:
    """Customers per segment with their share and mean figures, largest segment first."""
    totals = summary.groupBy("customer_segment").agg(
        F.count("*").alias("n"),
        F.sum("total_spent").alias("spent"),
        F.sum("total_orders").alias("orders"),
        F.sum("days_since_last_order").alias("idle"),
        F.count("days_since_last_order").alias("idle_known"),
    )
    # the total runs over one row per segment, not over the customers
    shares = totals.withColumn("percentage", percent("n", F.sum("n").over(Window.partitionBy())))
    return shares.select(
        "customer_segment",
        F.col("n").alias("customer_count"),
        "percentage",
        mean("spent", "n").alias("avg_total_spent"),
        mean("orders", "n").alias("avg_total_orders"),
        mean("idle", "idle_known").alias("avg_days_since_last_order"),
    ).orderBy(F.desc("customer_count"), "customer_segment")


def customer_geography(orders: DataFrame, addresses: DataFrame) -> DataFrame:
    """Most used shipping place per customer, by orders that are not cancelled.

    Orders are counted per (customer, address) first, so the address join sees each pair once.
    """
    used = not_cancelled(orders).groupBy("customer_id", "shipping_address_id").agg(F.count("*").alias("n"))
    places = addresses.select(F.col("address_id").alias("shipping_address_id"), "city", "state", "country")
    placed = used.join(places, "shipping_address_id")
    placed = placed.withColumn("place", F.struct("city", "state", "country"))
    best = most_frequent(placed, ["customer_id"], "place", F.sum("n"), "place", "orders_to_place")
    return best.select(
        "customer_id",
        F.col("place.city").alias("primary_shipping_city"),
        F.col("place.state").alias("primary_shipping_state"),
        F.col("place.country").alias("primary_shipping_country"),
        "orders_to_place",
    )


def customer_behaviour(
    orders: DataFrame, items: DataFrame, products: DataFrame, categories: DataFrame
) -> DataFrame:
    """Favourite category by units, all units and distinct products per customer."""
    buyers = not_cancelled(orders).select("order_id", "customer_id")
    bought = (
        order_product_units(items)
        .join(buyers, "order_id")
        .groupBy("customer_id", "product_id")
        .agg(F.sum("units").alias("units"))
    )
    named = products.select("product_id", "category_id").join(
        categories.select("category_id", "category_name"), "category_id", "left"
    )
    per_category = (
        bought.join(named.select("product_id", "category_name"), "product_id", "left")
        .groupBy("customer_id", "category_name")
        .agg(F.sum("units").alias("units"), F.count("*").alias("products"))
    )
    order = F.struct((-F.col("units")).alias("m"), F.col("category_name"))
    # products without a known category can not be the favourite one
    favourite = F.min_by(F.col("category_name"), F.when(F.col("category_name").isNotNull(), order))
    favourite = favourite.alias("favorite_category")
    return per_category.groupBy("customer_id").agg(
        favourite,
        F.sum("units").cast("bigint").alias("total_products_purchased"),
        F.sum("products").cast("bigint").alias("unique_products_purchased"),
    )


def customer_clean(customers: DataFrame, as_of: Moment, batch_id: str) -> DataFrame:
    """Customers with an email, names joined, email in lower case, age where the birth date is known."""
    kept = customers.dropna(subset=["email"])
    named = kept.withColumn("customer_name", full_name("first_name", "last_name"))
    if "date_of_birth" in customers.columns:
        named = named.withColumn("age", age_years("date_of_birth", as_of))
    return (
        named.withColumn("email", normalised_email("email"))
        .withColumn("processed_at", moment(as_of))
        .withColumn("etl_batch_id", F.lit(batch_id))
    )


def customer_spend_report(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of any status and their total per customer, biggest spender first."""
    spend = orders.groupBy("customer_id").agg(
        F.count("order_id").alias("n"), F.sum("total_amount").alias("spent")
    )
    joined = customers.select("customer_id", "first_name", "last_name", "email").join(spend, "customer_id", "left")
    return joined.select(
        "first_name",
        "last_name",
        "email",
        zero_if_null("n").cast("bigint").alias("total_orders"),
        total(zero_if_null("spent")).alias("total_spent"),
    ).orderBy(F.desc("total_spent"), "email")


def top_customers_by_segment(summary: DataFrame, segment: str) -> DataFrame:
    return summary.where(F.col("customer_segment") == segment).orderBy(F.desc("total_spent"), "customer_id")


def customer_lookup(summary: DataFrame, customer_id: int) -> DataFrame:
    """The published columns of one customer's summary."""
    return summary.where(F.col("customer_id") == customer_id).select(
        "customer_id",
        "customer_email",
        "customer_name",
        "total_orders",
        "total_spent",
        "avg_order_value",
        "customer_segment",
        "last_order_date",
        "days_since_last_order",
    )


def customer_report(
    summary: DataFrame, geography: DataFrame, behaviour: DataFrame
) -> DataFrame:
    """The full summary row: order figures with place and behaviour, all keyed by customer."""
    extra = behaviour.select("customer_id", "favorite_category", "unique_products_purchased")
    wide = summary.join(geography.drop("orders_to_place"), "customer_id", "left").join(extra, "customer_id", "left")
    return wide.withColumn("unique_products_purchased", zero_if_null("unique_products_purchased").cast("bigint"))
