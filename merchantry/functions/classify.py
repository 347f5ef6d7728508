"""Business classes as CASE chains; the first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry.functions.scalar import band, col
from merchantry.rules import Rules

# The class names below are what stored summaries and reports contain.


def customer_segment(
    rules: Rules,
    orders: str = "total_orders",
    idle_days: str = "days_since_last_order",
    spent: str = "total_spent",
) -> Column:
    return (
        F.when(col(orders) == 0, "new")
        .when(col(idle_days) > rules.churned_after_days, "churned")
        .when(col(idle_days) > rules.at_risk_after_days, "at_risk")
        .when((col(spent) > rules.vip_above_spent) | (col(orders) > rules.vip_above_orders), "vip")
        .when(col(orders) > rules.regular_above_orders, "regular")
        .otherwise("new")
    )


def lifetime_value_tier(rules: Rules, spent: str = "total_spent") -> Column:
    steps = [(rules.premium_from, "premium"), (rules.high_from, "high"), (rules.medium_from, "medium")]
    return band(spent, steps, "low", strict=False)


def performance_tier(rules: Rules, revenue: str = "total_revenue") -> Column:
    steps = [
        (rules.top_revenue_from, "top"),
        (rules.high_revenue_from, "high"),
        (rules.medium_revenue_from, "medium"),
    ]
    return band(revenue, steps, "low", strict=False)


def velocity_category(rules: Rules, units_per_month: str | Column) -> Column:
    steps = [
        (rules.very_fast_from, "very_fast"),
        (rules.fast_from, "fast"),
        (rules.normal_from, "normal"),
    ]
    return band(units_per_month, steps, "slow", strict=False)


def stock_status(balance: str | Column, reorder_level: str | Column, strict: bool = False) -> Column:
    """The published rule asks for the reorder level first, so a level of zero or more hides
    `out_of_stock`; `strict` asks for an empty shelf first."""
    empty, low = col(balance) <= 0, col(balance) <= col(reorder_level)
    if strict:
        return F.when(empty, "out_of_stock").when(low, "reorder").otherwise("in_stock")
    return F.when(low, "reorder").when(empty, "out_of_stock").otherwise("in_stock")


def selectivity_level(distinct_values: str | Column) -> Column:
    n = col(distinct_values)
    return (
        F.when(n == 0, "No selectivity")
        .when(n < 10, "Low selectivity")
        .when(n < 100, "Medium selectivity")
        .otherwise("High selectivity")
    )


def class_rank(name: str | Column, ordered: list[str]) -> Column:
    """Position of a class in its declared order, for sorting by rank and not by text."""
    return F.array_position(F.lit(ordered), col(name))
