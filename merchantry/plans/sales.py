"""Daily sales, their breakdowns, backfills and the monthly trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.scalar import (
    Moment,
    before,
    is_weekend,
    mean,
    mean_money,
    moment,
    total,
    weekday_name,
    year_month,
    zero_if_null,
)
from merchantry.operators.aggregates import exact_median
from merchantry.plans.customers import not_cancelled, order_product_units
from merchantry.rules import Rules
from merchantry.sources.shared import PARTITIONS, partitions_for, small_tasks, written
from merchantry.sources.sinks import merge_upsert

DAY = "summary_date"


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.to_date("created_at"))


def daily_sales_summary(orders: DataFrame, customers: DataFrame, as_of: Moment) -> DataFrame:
    """Every day in one pass: orders, value, buyers and how many of them are new.

    Orders are combined to (day, customer) before they meet the customers. That replaces
    the distinct counts, and a customer who placed most of the orders joins as a few rows.
    New means created no earlier than the day before.
    """
    pairs = (
        _by_day(not_cancelled(orders))
        .groupBy(DAY, "customer_id")
        .agg(
            # order_id is the key of orders, so counting it counts distinct orders
            F.count("order_id").alias("orders"),
            F.sum("total_amount").alias("value"),
            F.count("total_amount").alias("priced"),
        )
    )
    known = customers.select("customer_id", F.col("created_at").alias("joined_at"))
    buyers = pairs.join(known, "customer_id").withColumn(
        "is_new", F.col("joined_at") >= F.date_sub(DAY, 1).cast("timestamp_ntz")
    )
    days = buyers.groupBy(DAY).agg(
        F.sum("orders").cast("bigint").alias("total_orders"),
        total(F.sum("value")).alias("total_order_value"),
        F.sum("priced").alias("priced"),
        F.count("*").alias("total_customers"),
        F.count_if("is_new").alias("new_customers"),
    )
    return days.select(
        DAY,
        "total_orders",
        "total_order_value",
        mean_money("total_order_value", "priced").alias("avg_order_value"),
        "total_customers",
        "new_customers",
        (F.col("total_customers") - F.col("new_customers")).alias("returning_customers"),
        weekday_name(DAY).alias("day_of_week"),
        is_weekend(DAY).alias("is_weekend"),
        moment(as_of).alias("last_calculated_at"),
    )


def daily_median(orders: DataFrame) -> DataFrame:
    live = _by_day(not_cancelled(orders))
    return exact_median(live, [DAY], "total_amount", "median_order_value")


def daily_top_places(orders: DataFrame, addresses: DataFrame) -> DataFrame:
    """City and state with most orders per day; the first name wins a tie.

    Orders are counted per (day, address) before the addresses join, and cities and states
    are ranked in the same two grouped steps.
    """
    used = _by_day(not_cancelled(orders)).groupBy(DAY, "shipping_address_id").agg(F.count("*").alias("n"))
    places = addresses.select(F.col("address_id").alias("shipping_address_id"), "city", "state")
    named = used.join(places, "shipping_address_id").selectExpr(
        DAY, "n", "stack(2, 'city', city, 'state', state) AS (kind, place)"
    )
    counted = named.groupBy(DAY, "kind", "place").agg(F.sum("n").alias("n"))

    def top(kind: str) -> Column:
        order = F.struct((-F.col("n")).alias("m"), F.col("place"))
        return F.min_by(F.struct("place", "n"), F.when(F.col("kind") == kind, order)).alias(kind)

    return counted.groupBy(DAY).agg(top("city"), top("state")).select(
        DAY,
        F.col("city.place").alias("top_city"),
        F.col("city.n").alias("top_city_orders"),
        F.col("state.place").alias("top_state"),
        F.col("state.n").alias("top_state_orders"),
    )


def daily_product_mix(
    orders: DataFrame, items: DataFrame, products: DataFrame, categories: DataFrame
) -> DataFrame:
    """Units, distinct products and the category with most revenue per day, in one pass over the items.

    An order counts for a category once. Orders are therefore combined to (day, category,
    order) before they are counted, in partial aggregates, so that one order with very many
    lines is no task of its own.
    """
    days = _by_day(not_cancelled(orders)).select("order_id", DAY)
    named = products.select("product_id", "category_id").join(
        categories.select("category_id", "category_name"), "category_id", "left"
    )
    sold = order_product_units(items).join(named.select("product_id", "category_name"), "product_id", "left")
    sold = sold.join(days, "order_id")
    per_product = sold.groupBy(DAY, "category_name", "product_id").agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue")
    )
    per_order = sold.groupBy(DAY, "category_name", "order_id").agg(F.lit(1).alias("one"))
    none = F.lit(None)
    counted = per_product.select(DAY, "category_name", "units", "revenue", "product_id", none.alias("order_id")).union(
        per_order.select(DAY, "category_name", none, none, none, "order_id")
    )
    per_category = counted.groupBy(DAY, "category_name").agg(
        F.sum("units").alias("units"),
        F.count("product_id").alias("products"),
        F.sum("revenue").alias("revenue"),
        F.count("order_id").alias("orders"),
    )
    best = F.min_by(
        F.struct("category_name", "revenue", "orders"),
        # products without a category can not be the best one
        F.when(
            F.col("category_name").isNotNull(),
            F.struct((-F.col("revenue")).alias("m"), F.col("category_name").alias("c")),
        ),
    )
    return per_category.groupBy(DAY).agg(
        F.sum("units").cast("bigint").alias("total_products_sold"),
        F.sum("products").cast("bigint").alias("unique_products_sold"),
        best.alias("b"),
    ).select(
        DAY,
        "total_products_sold",
        "unique_products_sold",
        F.col("b.category_name").alias("top_category"),
        total("b.revenue").alias("top_category_revenue"),
        F.col("b.orders").cast("bigint").alias("top_category_orders"),
    )


def daily_status_counts(orders: DataFrame) -> DataFrame:
    """Payment and status counts over all orders of a day, cancelled ones included."""

    def having(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return (
        _by_day(orders)
        .groupBy(DAY)
        .agg(
            having("payment_status", "paid").alias("paid_orders"),
            having("payment_status", "pending").alias("pending_orders"),
            having("order_status", "cancelled").alias("cancelled_orders"),
            having("order_status", "refunded").alias("refunded_orders"),
        )
    )


def daily_processing(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Mean hours from order to its first shipment, and orders shipped on their day.

    Shipments dated before their order are ignored; orders without a shipment count in neither.
    """
    # distinct first: an order with very many shipment rows joins as its few dates
    sent = shipments.select("order_id", "shipped_at").distinct()
    live = _by_day(not_cancelled(orders)).select("order_id", DAY, "created_at")
    first = (
        live.join(sent, "order_id")
        .where(F.col("shipped_at") >= F.col("created_at"))
        .groupBy("order_id", DAY, "created_at")
        .agg(F.min("shipped_at").alias("shipped_at"))
    )
    hours = F.timestamp_diff("HOUR", F.col("created_at"), F.col("shipped_at"))
    return (
        first.groupBy(DAY)
        .agg(
            F.sum(hours).alias("hours"),
            F.count("*").alias("n"),
            F.count_if(F.to_date("shipped_at") == F.col(DAY)).alias("same_day_shipments"),
        )
        .select(DAY, mean("hours", "n").alias("avg_processing_time_hours"), "same_day_shipments")
    )


def daily_sales_report(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    addresses: DataFrame,
    shipments: DataFrame,
    as_of: Moment,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The full daily row. Each feature is one row per day by then, so the joins are small.

    Sorts and hash tables of a task grow with the rows of its partition. Where the session's
    partitions are too few for the rows, the report is computed with more of them and written
    to the shared folder: it is then a table as of this call.
    """
    report = _daily_report(orders, customers, items, products, categories, addresses, shipments, as_of, holidays)
    spark = orders.sparkSession
    partitions = partitions_for(spark, max(df.count() for df in (orders, items, shipments)))
    if partitions <= int(spark.conf.get(PARTITIONS)):
        return report
    with small_tasks(spark, partitions):
        return written(report, "daily-report")


def _daily_report(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    addresses: DataFrame,
    shipments: DataFrame,
    as_of: Moment,
    holidays: DataFrame | None,
) -> DataFrame:
    parts = [
        daily_median(orders),
        daily_product_mix(orders, items, products, categories),
        daily_top_places(orders, addresses),
        daily_status_counts(orders),
        daily_processing(orders, shipments),
    ]
    report = daily_sales_summary(orders, customers, as_of)
    for part in parts:
        report = report.join(part, DAY, "left")
    zeros = [
        "total_products_sold",
        "unique_products_sold",
        "top_city_orders",
        "top_state_orders",
        "top_category_orders",
        "same_day_shipments",
    ]
    report = report.withColumns({c: zero_if_null(c).cast("bigint") for c in zeros})
    if holidays is None:
        return report.withColumn("is_holiday", F.lit(False))
    marked = holidays.select(F.col("holiday").alias(DAY), F.lit(True).alias("_holiday")).distinct()
    return (
        report.join(marked, DAY, "left")
        .withColumn("is_holiday", F.coalesce("_holiday", F.lit(False)))
        .drop("_holiday")
    )


def daily_range(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Published daily columns between two dates, both included, newest first."""
    return (
        daily.where(F.col(DAY).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .select(
            DAY,
            "total_orders",
            "total_order_value",
            "avg_order_value",
            "total_customers",
            "new_customers",
            "day_of_week",
            "is_weekend",
        )
        .orderBy(F.desc(DAY))
    )


def recent_days(orders: DataFrame, as_of: Moment, days: int) -> DataFrame:
    """Orders of the last `days` full days, as a half-open range that Parquet can skip by."""
    start = F.date_trunc("DAY", before(as_of, f"{days} days")).cast("timestamp_ntz")
    end = F.date_trunc("DAY", moment(as_of)).cast("timestamp_ntz")
    return orders.where((F.col("created_at") >= start) & (F.col("created_at") < end))


def with_emptied_days(fresh: DataFrame, days: DataFrame, as_of: Moment) -> DataFrame:
    """The recomputed days, and a row of zeros for each of `days` that has no order left.

    Without it a day whose orders were all cancelled would keep its old figures in an upsert.
    """
    gone = days.select(DAY).distinct().join(fresh.select(DAY), DAY, "left_anti")
    counts = ("total_orders", "total_customers", "new_customers", "returning_customers")
    values = {
        **{c: F.lit(0) for c in (*counts, "total_order_value")},
        "avg_order_value": F.lit(None),
        "day_of_week": weekday_name(DAY),
        "is_weekend": is_weekend(DAY),
        "last_calculated_at": moment(as_of),
    }
    zeros = gone.select(*[(values[c] if c in values else F.col(c)).cast(kind).alias(c) for c, kind in fresh.dtypes])
    return fresh.unionByName(zeros)


def in_backfill(daily: DataFrame, as_of: Moment, days: int) -> DataFrame:
    """Stored rows of the last full days."""
    first, end = F.to_date(before(as_of, f"{days} days")), F.to_date(moment(as_of))
    return daily.where((F.col(DAY) >= first) & (F.col(DAY) < end))


def backfill_daily(
    daily: DataFrame, orders: DataFrame, customers: DataFrame, as_of: Moment, rules: Rules
) -> DataFrame:
    """The daily table after the last days are computed anew and upserted."""
    fresh = daily_sales_summary(recent_days(orders, as_of, rules.backfill_days), customers, as_of)
    stored = in_backfill(daily, as_of, rules.backfill_days)
    return merge_upsert(daily, with_emptied_days(fresh, stored, as_of), [DAY])


def monthly_sales_trend(daily: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    """Months of the trend window, newest first; the order value is the mean of the days' means."""
    since = F.to_date(before(as_of, f"{rules.trend_months} months"))
    months = (
        daily.where(F.col(DAY) >= since)
        .groupBy(year_month(DAY).alias("month"))
        .agg(
            F.sum("total_orders").cast("bigint").alias("monthly_orders"),
            total(F.sum("total_order_value")).alias("monthly_revenue"),
            F.sum("avg_order_value").alias("averages"),
            F.count("avg_order_value").alias("priced_days"),
            F.sum("new_customers").cast("bigint").alias("new_customers_acquired"),
            F.sum("total_customers").alias("buyers"),
            F.count("total_customers").alias("days"),
        )
    )
    return months.select(
        "month",
        "monthly_orders",
        "monthly_revenue",
        mean("averages", "priced_days").alias("avg_monthly_order_value"),
        "new_customers_acquired",
        mean("buyers", "days").alias("avg_daily_customers"),
    ).orderBy(F.desc("month"))
