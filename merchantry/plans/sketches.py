"""Summaries that are stored per period and added up on read: quantiles and distinct counts.

A new day costs one day: its sketches are computed from its rows alone, and those of a month or a
year are merged from stored ones, which hold a few kilobytes each however many rows they saw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.operators.joins import same_keys, small_side

QUANTILE_K = 400
RANK_ERROR = 0.01  # of a KLL sketch with QUANTILE_K, in shares of the rows; holds in 99 of 100 cases
DISTINCT_LG_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_LG_K / 2)  # relative standard error of an HLL sketch


def quantile_sketches(df: DataFrame, periods: Sequence[str | Column], value: str, k: int = QUANTILE_K) -> DataFrame:
    """Per period the number of non-null values and their KLL sketch, combined before the shuffle.

    A period without a value has a NULL sketch and 0 values.
    """
    number = F.col(value).cast("double")
    made = df.groupBy(*periods).agg(F.count(number).alias("n"), F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))
    return made.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged_quantiles(sketches: DataFrame, periods: Sequence[str | Column], shares: dict[str, float], k: int = QUANTILE_K) -> DataFrame:
    """Stored sketches merged to longer periods, with the value at each of the named shares of the rows.

    Merging loses nothing: a merged sketch has the error of one over all rows.
    """
    full = F.when(F.col("n") > 0, F.col("sketch"))
    merged = sketches.groupBy(*periods).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(full, F.lit(k)).alias("sketch"))
    found = [
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias(name)
        for name, share in shares.items()
    ]
    return merged.select(*[c for c in merged.columns if c != "sketch"], *found)


def rank_shares(df: DataFrame, periods: Sequence[str], value: str, found: DataFrame, estimate: str) -> DataFrame:
    """Per period the shares of values below, and not above, an estimated one: between them lies the
    share it was asked for, if it is exact. `found` has a row per period."""
    few = small_side(found.select(*[F.col(p).alias(f"_{p}") for p in periods], F.col(estimate).alias("_estimate")))
    joined = df.where(F.col(value).isNotNull()).join(few, same_keys(list(periods), [f"_{p}" for p in periods]))
    number = F.col(value).cast("double")

    def share(condition: Column) -> Column:
        return F.count(F.when(condition, 1)) / F.count("*")

    return joined.groupBy(*periods).agg(
        share(number < F.col("_estimate")).alias("below"), share(number <= F.col("_estimate")).alias("not_above")
    )


def distinct_sketches(df: DataFrame, periods: Sequence[str | Column], columns: Sequence[str], lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """Per period and column: rows, non-null values and an HLL sketch of the distinct ones.

    All columns are sketched in one pass, and what is shuffled is a sketch per task, period and
    column, never the values. Values count by their text.
    """
    figures = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("total_rows"),
            F.count(c).alias("filled"),
            F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias("sketch"),
        )
        for c in columns
    ]
    wide = df.groupBy(*periods).agg(F.array(*figures).alias("_columns"))
    return wide.select(*[c for c in wide.columns if c != "_columns"], F.inline("_columns"))


def merged_selectivity(sketches: DataFrame) -> DataFrame:
    """Per column over all stored periods: rows, estimated distinct values and their share in percent."""
    merged = sketches.groupBy("column_name").agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("filled").alias("filled"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
    share = F.round(100 * F.col("distinct_values") / F.col("total_rows"), 2)
    return merged.withColumn("selectivity_percent", F.when(F.col("total_rows") > 0, share))
