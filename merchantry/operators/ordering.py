"""Ranks, running totals, latest rows and top-k without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.operators.joins import same_keys
from merchantry.sources.shared import Scratch, written

BUCKETS_PER_PARTITION = 4


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Sort and limit in one step: each task keeps k rows. Give a unique last order column."""
    return df.orderBy(*order).limit(k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by `order_by`.

    An aggregate and not a window: every map task sends one row per key, so a key that
    holds most of the rows never gathers in one task.
    """
    row = F.struct(*df.columns)
    order = F.struct(*order_by)
    picked = df.groupBy(*keys).agg(F.max_by(row, order).alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def running_before(
    df: DataFrame,
    value: str,
    weight: str,
    name: str,
    groups: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
    cuts_from: DataFrame | None = None,
) -> DataFrame:
    """Add the weight of all rows that come before this row's value in its group.

    `df` holds each (groups, value) once. Values are cut into quantile buckets, by default a
    few per shuffle partition, so that they grow with the cluster. Bucket totals (at most
    `buckets` rows per group) give each bucket its offset, and the running sum is taken
    inside a bucket. The driver sees the cut points only, and a group of any
    size spreads over all buckets. NULL values sort lowest.

    `cuts_from` is a frame with the same value column to take the quantiles from, such as
    the rows before they were counted, which saves computing `df` twice. The cut points
    decide how even the buckets are and never the result.
    """
    if buckets is None:
        buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.lit(float("-inf"))
    keyed = df.withColumn("_at", F.coalesce(F.col(value).cast("double"), lowest))
    probabilities = [i / buckets for i in range(1, buckets)] or [0.5]
    values = (df if cuts_from is None else cuts_from).select(F.col(value).cast("double").alias("_at"))
    cuts = values.approxQuantile("_at", probabilities, 1 / (4 * buckets))
    splits = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]  # 0.0: at least one cut is required
    keyed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(keyed)

    def sort(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    def earlier(partition: Sequence[str], order: str) -> Window:
        w = Window.partitionBy(*partition).orderBy(sort(order))
        return w.rowsBetween(Window.unboundedPreceding, -1)

    totals = keyed.groupBy(*groups, "_bucket").agg(F.sum(weight).alias("_total"))
    offsets = totals.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col("_bucket").alias("_b"),
        F.sum("_total").over(earlier(groups, "_bucket")).alias("_offset"),
    )
    same = same_keys([*groups, "_bucket"], [*[f"_{g}" for g in groups], "_b"])
    inside = F.sum(weight).over(earlier([*groups, "_bucket"], value))
    placed = keyed.join(offsets, same).withColumn(
        name, F.coalesce(F.col("_offset"), F.lit(0)) + F.coalesce(inside, F.lit(0))
    )
    return placed.select(*df.columns, name)


def global_rank(
    df: DataFrame, by: str, name: str, descending: bool = True, buckets: int | None = None
) -> DataFrame:
    """RANK over the whole frame, without a window over all rows.

    Equal values are counted first, so that ties collapse, and the distinct values are placed by
    buckets. Counts and ranks are written to the shared folder, so the frame is computed twice,
    for the counts and for the rank to join it, and a rank of a rank does not multiply that.
    """
    with Scratch(df.sparkSession, "ties") as scratch:
        ties = scratch.written(df.groupBy(F.col(by).alias("_value")).agg(F.count("*").alias("_n")), "ties")
        placed = running_before(ties, "_value", "_n", "_before", (), descending, buckets)
        ranks = written(placed.select("_value", (F.col("_before") + 1).cast("bigint").alias(name)), "ranks")
    return df.join(ranks, F.col(by).eqNullSafe(F.col("_value")), "left").drop("_value")


def running_total(df: DataFrame, groups: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Cumulative sum per group, for groups whose size is bounded (such as months)."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
