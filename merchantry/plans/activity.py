"""Active customers over any span, from bitmaps of their ids that are stored per day.

Daily distinct counts cannot be added up: a customer of two days is one customer of the month.
Bitmaps can be united. A bucket of 32,768 neighbouring ids is four kilobytes a day however many
orders it has; a new day costs one day, and counts of longer spans are exact. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "id_bucket"
BITS = "bits"


def id_bitmaps(df: DataFrame, periods: Sequence[str | Column], key: str) -> DataFrame:
    """Per period and bucket of ids a bitmap of those that occur. Rows without an id count for nobody."""
    number = F.col(key).cast("bigint")
    return (
        df.where(number.isNotNull())
        .groupBy(*periods, F.bitmap_bucket_number(number).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS))
    )


def united(bitmaps: DataFrame, periods: Sequence[str | Column]) -> DataFrame:
    """Stored bitmaps united to longer periods."""
    return bitmaps.groupBy(*periods, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def active(bitmaps: DataFrame, periods: Sequence[str], name: str = "active") -> DataFrame:
    """Distinct ids per period; a period must have one bitmap a bucket."""
    return bitmaps.groupBy(*periods).agg(F.sum(F.bitmap_count(BITS)).alias(name))


def newly_active(bitmaps: DataFrame, period: str, name: str = "newly_active") -> DataFrame:
    """Ids per period that no earlier period has. A bucket holds one bitmap a period, so its
    window is as long as the history has periods."""
    so_far = F.bitmap_count(F.bitmap_or_agg(BITS).over(Window.partitionBy(BUCKET).orderBy(period)))
    grown = bitmaps.select(period, BUCKET, so_far.alias("_so_far"))
    before = F.lag("_so_far", 1, 0).over(Window.partitionBy(BUCKET).orderBy(period))
    gained = grown.select(period, (F.col("_so_far") - before).alias("_gained"))
    return gained.groupBy(period).agg(F.sum("_gained").alias(name))


def retained(bitmaps: DataFrame, period: str, lags: Sequence[int]) -> DataFrame:
    """Ids per period, a whole number, that were active as many periods earlier, in a column
    `retained_N` for each of the lags.

    A bitmap goes to its own period and to those that look back at it, where the two are
    intersected; nothing is shuffled but bitmaps, 2 for each lag.
    """
    looks = [F.struct(F.lit(n).alias("lag"), F.lit(own).alias("own")) for n in lags for own in (True, False)]
    pairs = bitmaps.select("*", F.explode(F.array(*looks)).alias("_look")).select(
        F.when(F.col("_look.own"), F.col(period)).otherwise(F.col(period) + F.col("_look.lag")).alias(period),
        F.col("_look.lag").alias("_lag"),
        "_look.own",
        BUCKET,
        BITS,
    )
    both = pairs.groupBy(period, "_lag", BUCKET).agg(
        F.bool_or("own").alias("_now"),
        F.when(F.count("*") == 2, F.bitmap_count(F.bitmap_and_agg(BITS))).otherwise(0).alias("_n"),
    )
    counts = [F.sum(F.when(F.col("_lag") == n, F.col("_n")).otherwise(0)).alias(f"retained_{n}") for n in lags]
    return both.groupBy(period).agg(F.bool_or("_now").alias("_now"), *counts).where("_now").drop("_now")


def activity_by_period(bitmaps: DataFrame, period: str, lags: Sequence[int]) -> DataFrame:
    """Active, new and retained ids per period, from one bitmap a period and bucket."""
    parts = [active(bitmaps, [period]), newly_active(bitmaps, period), retained(bitmaps, period, lags)]
    return reduce(lambda a, b: a.join(b, period), parts)
