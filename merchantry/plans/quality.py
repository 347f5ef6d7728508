"""Data-quality jobs: what a relational store would enforce, as reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions.scalar import money, same_text, total, zero_if_null
from merchantry.plans.products import product_inventory


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def orphans(name: str, child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of `child` whose parent is missing, as one report row.

    Child rows are counted per key before the shuffle, so a parent with most of the
    children is one row in the join.
    """
    counted = child.where(F.col(foreign_key).isNotNull()).groupBy(F.col(foreign_key).alias("_fk"))
    counted = counted.agg(F.count("*").alias("_n"))
    missing = counted.join(parent.select(F.col(key).alias("_key")), F.col("_fk") == F.col("_key"), "left_anti")
    return missing.agg(
        F.lit(name).alias("check_name"),
        zero_if_null(F.sum("_n")).cast("bigint").alias("orphan_rows"),
        F.count("*").alias("orphan_keys"),
    )


def duplicates(name: str, df: DataFrame, columns: Sequence[str], any_case: bool = False) -> DataFrame:
    """Keys that occur more than once, and the rows beyond the first, as one report row.

    `any_case` compares text without regard to case and accents. NULL keys are allowed to repeat.
    """
    keys = [same_text(c).alias(c) if any_case else F.col(c) for c in columns]
    repeated = df.dropna(subset=list(columns)).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return repeated.agg(
        F.lit(name).alias("check_name"),
        F.count("*").alias("duplicate_keys"),
        zero_if_null(F.sum(F.col("_n") - 1)).cast("bigint").alias("extra_rows"),
    )


def _unpivoted(one_row: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one_row.selectExpr("table_name", f"stack({len(names)}, {pairs}) AS (column_name, {value})")


def missing_values(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column, all columns in one pass over the table."""
    counts = df.agg(
        F.lit(table).alias("table_name"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return _unpivoted(counts, columns, "null_rows")


def outside_domain(table: str, df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values per column that are not members of its enumeration; NULL is no violation."""
    counts = df.agg(
        F.lit(table).alias("table_name"),
        *[F.count_if(~F.col(c).isin(*members)).alias(c) for c, members in domains.items()],
    )
    return _unpivoted(counts, list(domains), "bad_rows")


def line_arithmetic(items: DataFrame) -> DataFrame:
    """Lines whose total is not quantity times unit price, with the difference."""
    expected = money(F.col("quantity") * F.col("unit_price"))
    return items.where(F.col("total_price") != expected).select(
        "order_id",
        "product_id",
        "quantity",
        "unit_price",
        "total_price",
        money(F.col("total_price") - expected).alias("difference"),
    )


def order_arithmetic(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total does not follow from its parts, or whose subtotal is not its lines.

    A missing total or subtotal follows from nothing: it is reported with a NULL gap.
    """
    lines = items.groupBy("order_id").agg(F.sum("total_price").alias("lines"))
    parts = (
        F.col("subtotal")
        + zero_if_null("tax_amount")
        + zero_if_null("shipping_amount")
        - zero_if_null("discount_amount")
    )
    compared = orders.join(lines, "order_id", "left").select(
        "order_id",
        total(F.col("total_amount") - parts).alias("total_gap"),
        total(F.col("subtotal") - zero_if_null("lines")).alias("lines_gap"),
    )
    return compared.where(~(F.col("total_gap").eqNullSafe(F.lit(0)) & F.col("lines_gap").eqNullSafe(F.lit(0))))


def stock_mismatches(products: DataFrame, movements: DataFrame) -> DataFrame:
    """Active products whose ledger balance differs from the recorded stock."""
    inventory = product_inventory(products, movements)
    gap = F.coalesce("system_stock", F.lit(0)) - F.col("calculated_stock")
    return inventory.withColumn("stock_gap", gap).where("stock_gap <> 0").select(
        "product_id", "sku", "system_stock", "calculated_stock", "stock_gap"
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    return stacked(
        [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("record_count")) for name, df in tables.items()]
    )
