"""Neighbouring ids dealt into buckets, so that an order over all rows needs no one-task sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_buckets(df: DataFrame, column: str, name: str, buckets: int) -> DataFrame:
    """Add an int column that rises with `column`; equal values share a bucket, nulls are in the first.

    The cut points are approximate quantiles, which decide how even buckets are and never
    their order. They are all the driver sees.
    """
    value = F.col(column).cast("double")
    steps = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = df.select(value.alias("at")).approxQuantile("at", steps, 0.25 / buckets)
    splits = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]  # one cut at least is required
    keyed = df.withColumn("_at", F.coalesce(value, F.lit(float("-inf"))))
    bucketed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(keyed)
    return bucketed.withColumn(name, F.col("_bucket").cast("int")).drop("_at", "_bucket")


def totals_before(totals: DataFrame, bucket: str, total: str, name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Add the sum of `total` over earlier buckets; `totals` has a row per bucket (and group) only."""
    window = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(total).over(window), F.lit(0)).cast("bigint"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
