"""Scheduled loads: the summaries computed and written to their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions.scalar import Moment
from merchantry.plans.customers import customer_order_summary, recent_customer_summary
from merchantry.plans.sales import DAY, daily_sales_summary, in_backfill, recent_days, with_emptied_days
from merchantry.rules import Rules
from merchantry.sources.shared import path_exists
from merchantry.sources.sinks import load, upsert_table

YEAR = "summary_year"


def by_year(daily: DataFrame) -> DataFrame:
    """The daily rows with the column their table is partitioned by."""
    return daily.withColumn(YEAR, F.year(DAY))


def rebuild_customer_summary(
    path: str, customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: Moment, rules: Rules
) -> None:
    """Replace the customer summary table; segments and tiers are columns of the one write."""
    load(customer_order_summary(customers, orders, items, as_of, rules), path, "replace")


def upsert_recent_customers(
    spark: SparkSession,
    path: str,
    customers: DataFrame,
    orders: DataFrame,
    as_of: Moment,
    rules: Rules,
    days: int = 30,
) -> None:
    """Update the summary rows of recently created customers; columns it does not compute stay."""
    fresh = recent_customer_summary(customers, orders, as_of, rules, days)
    upsert_table(spark, path, fresh, ["customer_id"])


def upsert_daily_sales(
    spark: SparkSession, path: str, customers: DataFrame, orders: DataFrame, as_of: Moment, rules: Rules
) -> None:
    """Compute the last full days anew and upsert them; only their years are rewritten."""
    recent = recent_days(orders, as_of, rules.backfill_days)
    fresh = daily_sales_summary(recent, customers, as_of)
    if path_exists(spark, path):
        fresh = with_emptied_days(fresh, in_backfill(spark.read.parquet(path), as_of, rules.backfill_days), as_of)
    upsert_table(spark, path, by_year(fresh), [DAY], partition_by=[YEAR])


def run_all(
    spark: SparkSession, folder: str, customers: DataFrame, orders: DataFrame, as_of: Moment, rules: Rules
) -> None:
    """The nightly run: recent customers, then the days of the backfill window."""
    upsert_recent_customers(spark, f"{folder}/customer_order_summary", customers, orders, as_of, rules)
    upsert_daily_sales(spark, f"{folder}/daily_sales_summary", customers, orders, as_of, rules)
