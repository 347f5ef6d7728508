"""Aggregations that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.scalar import percent
from merchantry.operators.joins import same_keys
from merchantry.operators.ordering import running_before


def share_of_total(df: DataFrame, group: str, count_name: str, share_name: str) -> DataFrame:
    """Rows per group and their share of all rows in percent.

    Groups are counted in partial aggregates, and the total is taken over their few rows; the
    frame is computed once.
    """
    counted = df.groupBy(group).agg(F.count("*").alias(count_name))
    whole = F.sum(count_name).over(Window.partitionBy())
    return counted.withColumn(share_name, percent(count_name, whole))


def most_frequent(
    df: DataFrame, keys: Sequence[str], name: str, measure: Column, value_name: str, measure_name: str
) -> DataFrame:
    """Per key the `name` with the largest measure; equal measures go to the first name.

    Two levels of partial aggregation, no window over the rows of a key.
    """
    totals = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(measure.alias("_m"))
    best = F.min_by(F.struct(F.col(name), F.col("_m")), F.struct((-F.col("_m")).alias("m"), F.col(name)))
    picked = totals.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(
        *keys, F.col("_best")[name].alias(value_name), F.col("_best")["_m"].alias(measure_name)
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """COUNT(DISTINCT column) per key in two grouped steps; NULLs are not counted."""
    return df.groupBy(*keys, column).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count(column).alias(name))


def exact_median(
    df: DataFrame, groups: Sequence[str], value: str, name: str, buckets: int | None = None
) -> DataFrame:
    """Exact median of a decimal column per group; the mean of two middle values is rounded
    half up to cents, once and at the end.

    Equal values are counted first, and the middle positions are found by bucketed running
    counts, so a group of any size spreads over many tasks.
    """
    present = df.where(F.col(value).isNotNull()).select(*groups, value)
    counts = present.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    placed = running_before(counts, value, "_n", "_before", groups, buckets=buckets, cuts_from=present)
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    names = [f"_of_{g}" for g in groups]
    both = placed.join(sizes.withColumnsRenamed(dict(zip(groups, names, strict=True))), same_keys(groups, names))
    end = F.col("_before") + F.col("_n")

    def covers(position: Column) -> Column:
        return ((F.col("_before") <= position) & (position < end)).cast("int")

    low, high = F.expr("(_size - 1) div 2"), F.expr("_size div 2")
    hits = (covers(low) + covers(high)).alias("_hits")
    middle = F.round(F.sum(F.col(value) * F.col("_hits")) / 2, 2)
    whole = present.schema[value].dataType.precision - present.schema[value].dataType.scale
    kind = f"decimal({min(38, max(whole + 2, 18))},2)"
    return both.select("*", hits).where("_hits > 0").groupBy(*groups).agg(middle.cast(kind).alias(name))
