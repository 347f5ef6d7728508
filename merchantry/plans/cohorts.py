"""Monthly cohorts: retention, revenue and churn by months since the first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.scalar import (
    Moment,
    mean_money,
    moment,
    money,
    month_index,
    percent,
    total,
    zero_if_null,
)
from merchantry.operators.ordering import running_total
from merchantry.plans.customers import not_cancelled


def _month_of(index: str) -> Column:
    year = F.expr(f"int({index} div 12)")
    month = F.expr(f"int({index} % 12) + 1")
    return F.make_date(year, month, F.lit(1))


def customer_cohorts(orders: DataFrame, as_of: Moment) -> DataFrame:
    """One row per cohort month and every month from it to the month of `as_of`.

    Orders shrink to (customer, month) before anything is compared per customer, so a
    customer with very many orders is a few rows. A customer counts as churned in the
    month after the last order; months after `as_of` do not exist yet.
    """
    edge = month_index(moment(as_of))
    monthly = (
        not_cancelled(orders)
        .where(F.col("created_at") <= moment(as_of))
        .withColumn("month", month_index("created_at"))
        .groupBy("customer_id", "month")
        .agg(F.count("order_id").alias("orders"), F.sum("total_amount").alias("revenue"))
    )
    own = Window.partitionBy("customer_id")
    active = monthly.select(
        "month",
        "orders",
        "revenue",
        F.min("month").over(own).alias("cohort"),
        (F.col("month") == F.max("month").over(own)).alias("is_last"),
    )
    by_period = active.groupBy("cohort", (F.col("month") - F.col("cohort")).alias("period")).agg(
        F.count("*").alias("active"),
        F.sum("orders").alias("orders"),
        F.sum("revenue").alias("revenue"),
        F.count_if("is_last").alias("leaving"),
    )
    # from here on there is one row per pair of months, so a cohort's months fit in one map
    facts = F.struct("active", "orders", "revenue", "leaving")
    per_cohort = by_period.groupBy("cohort").agg(
        F.max(F.when(F.col("period") == 0, F.col("active"))).alias("size"),
        F.map_from_entries(F.collect_list(F.struct(F.col("period"), facts.alias("facts")))).alias("by_period"),
    )
    periods = F.explode(F.sequence(F.lit(0).cast("bigint"), edge - F.col("cohort"))).alias("period")
    grid = per_cohort.select("cohort", "size", "by_period", periods)
    filled = grid.withColumn("facts", F.try_element_at("by_period", F.col("period"))).select(
        "cohort",
        "period",
        "size",
        *[zero_if_null(f"facts.{c}").alias(c) for c in ("active", "orders", "leaving")],
        total(zero_if_null("facts.revenue")).alias("revenue"),
    )
    ordered = Window.partitionBy("cohort").orderBy("period")
    filled = filled.withColumn("churned", F.lag("leaving", 1, 0).over(ordered))
    filled = running_total(filled, ["cohort"], "period", "revenue", "cumulative")
    return filled.select(
        _month_of("cohort").alias("cohort_month"),
        F.col("period").alias("period_number"),
        F.col("size").alias("customers_in_cohort"),
        F.col("active").alias("active_customers"),
        percent("active", "size").alias("retention_rate"),
        F.col("revenue").alias("total_revenue"),
        mean_money("revenue", "size").alias("avg_revenue_per_customer"),
        total("cumulative").alias("cumulative_revenue"),
        F.col("orders").cast("bigint").alias("total_orders"),
        money(zero_if_null(mean_money(F.col("orders").cast("decimal(20,2)"), "active"))).alias(
            "avg_orders_per_customer"
        ),
        F.when(F.col("period") == 0, F.col("size")).otherwise(F.lit(0)).cast("bigint").alias(
            "new_customers_this_period"
        ),
        F.col("churned").cast("bigint").alias("churned_customers_this_period"),
    )


def cohorts_since(cohorts: DataFrame, month: str) -> DataFrame:
    return cohorts.where(F.col("cohort_month") >= F.lit(month).cast("date"))
