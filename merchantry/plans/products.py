"""Product performance, ranking, inventory and category paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions.classify import performance_tier, stock_status, velocity_category
from merchantry.functions.scalar import (
    MONEY,
    Moment,
    days_since,
    mean_money,
    moment,
    percent,
    total,
    whole_months,
    zero_if_null,
)
from merchantry.operators.joins import hierarchy_paths
from merchantry.operators.ordering import global_rank
from merchantry.plans.customers import not_cancelled, order_product_units
from merchantry.rules import Rules
from merchantry.sources.shared import written


def category_paths(categories: DataFrame) -> DataFrame:
    """Root-to-leaf path of every category."""
    paths = hierarchy_paths(categories, "category_id", "parent_category_id", "category_name")
    named = categories.select("category_id", "category_name")
    return named.join(paths, "category_id").select(
        "category_id", "category_name", F.col("path").alias("category_hierarchy"), "depth"
    )


def product_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Units, revenue, orders and buyers per product over orders that are not cancelled.

    Two grouped steps, (product, customer) and then product, count orders and buyers
    without a distinct count, and a best-seller is combined on the map side in both.
    """
    sold = order_product_units(items).join(
        not_cancelled(orders).select("order_id", "customer_id", "created_at"), "order_id"
    )
    per_buyer = sold.groupBy("product_id", "customer_id").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.count("*").alias("orders"),
        F.min("created_at").alias("first_sale"),
        F.max("created_at").alias("last_sale"),
    )
    return per_buyer.groupBy("product_id").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        F.count("*").alias("buyers"),
        F.min("first_sale").alias("first_sale_date"),
        F.max("last_sale").alias("last_sale_date"),
    )


def product_performance(
    products: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    categories: DataFrame,
    as_of: Moment,
    rules: Rules,
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per product with its sales, profit and classes; zeros for products never sold.

    `period` limits the orders to dates from the first to the second, both included.
    """
    if period:
        start, end = (F.lit(d).cast("date") for d in period)
        orders = orders.where(
            (F.col("created_at") >= start.cast("timestamp_ntz"))
            & (F.col("created_at") < F.date_add(end, 1).cast("timestamp_ntz"))
        )
    named = products.join(category_paths(categories).drop("depth"), "category_id", "left")
    wide = named.join(product_sales(items, orders), "product_id", "left").select(
        "product_id",
        "sku",
        "product_name",
        "category_name",
        "category_hierarchy",
        zero_if_null("units").cast("bigint").alias("total_quantity_sold"),
        total(zero_if_null("revenue")).alias("total_revenue"),
        total(zero_if_null("units") * F.col("cost")).alias("total_cost"),
        zero_if_null("orders").cast("bigint").alias("total_orders"),
        zero_if_null("buyers").cast("bigint").alias("unique_customers"),
        "first_sale_date",
        "last_sale_date",
        days_since("last_sale_date", as_of).alias("days_since_last_sale"),
        F.col("price").alias("current_price"),
        F.col("stock_quantity").alias("current_stock"),
        "reorder_level",
        "is_active",
    )
    months = whole_months("first_sale_date", "last_sale_date") + 1
    speed = F.col("total_quantity_sold").cast("double") / months.cast("double")
    profit = F.col("total_revenue") - F.col("total_cost")
    begin, finish = (F.lit(d).cast("date") for d in period) if period else (
        F.to_date("first_sale_date"),
        F.to_date(moment(as_of)),
    )
    return (
        wide.withColumn("total_profit", total(profit))
        .withColumn("profit_margin_percent", percent("total_profit", "total_revenue"))
        .withColumn(
            "avg_quantity_per_order",
            mean_money(F.col("total_quantity_sold").cast("decimal(20,2)"), "total_orders"),
        )
        .withColumn("avg_revenue_per_order", mean_money("total_revenue", "total_orders"))
        .withColumn("performance_tier", performance_tier(rules))
        .withColumn("velocity_category", velocity_category(rules, speed))
        .withColumn("summary_period_start", begin)
        .withColumn("summary_period_end", finish)
        .withColumn("last_calculated_at", moment(as_of))
    )


def top_performing_products(performance: DataFrame) -> DataFrame:
    """Active products ranked by revenue and by units, best revenue first.

    Both ranks need the whole summary several times, so its few columns are written down once.
    """
    active = performance.where("is_active").select(
        "product_id",
        "sku",
        "product_name",
        "category_name",
        "total_quantity_sold",
        "total_revenue",
        "total_profit",
        "profit_margin_percent",
        "performance_tier",
        "velocity_category",
        "unique_customers",
    )
    ranked = global_rank(written(active, "active-products"), "total_revenue", "revenue_rank")
    ranked = global_rank(ranked, "total_quantity_sold", "quantity_rank")
    return ranked.orderBy(F.desc("total_revenue"), "product_id")


def stock_balance(movements: DataFrame) -> DataFrame:
    return movements.groupBy("product_id").agg(F.sum("quantity").alias("balance"))


def product_inventory(products: DataFrame, movements: DataFrame, strict: bool = False) -> DataFrame:
    """Ledger balance against the recorded stock of active products, by name."""
    balance = zero_if_null("balance").cast("bigint")
    joined = products.where("is_active").join(stock_balance(movements), "product_id", "left")
    return joined.select(
        "product_id",
        "sku",
        "product_name",
        F.col("stock_quantity").alias("system_stock"),
        balance.alias("calculated_stock"),
        "reorder_level",
        stock_status(balance, "reorder_level", strict).alias("stock_status"),
    ).orderBy("product_name", "product_id")


def inventory_lookup(inventory: DataFrame, sku: str | None = None) -> DataFrame:
    """All products, or the one with the given sku, by name."""
    found = inventory if sku is None else inventory.where(F.col("sku") == sku)
    return found.orderBy("product_name", "product_id")


def low_stock(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("stock_status").isin("reorder", "out_of_stock"))


def public_products(products: DataFrame) -> DataFrame:
    """The product columns that outside readers may see."""
    return products.select("product_id", "sku", "product_name", "price", "is_active")


def public_categories(categories: DataFrame) -> DataFrame:
    """The category columns that outside readers may see."""
    return categories.select("category_id", "category_name", "is_active")


def gross_margin(products: DataFrame) -> DataFrame:
    """List-price profit and margin per product; a product without cost has neither."""
    profit = (F.col("price") - F.col("cost")).cast(MONEY)
    return products.select(
        "product_id", "price", "cost", profit.alias("profit"), percent(profit, "price").alias("margin_percent")
    )
