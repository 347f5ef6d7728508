"""Differences of large snapshots: only the parts whose digests differ are read and joined.

A snapshot is stored in parts by a hash of its key, with one digest a part: the number of rows and
the sum of their hashes, which no order of rows changes. Two snapshots compare their digests first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions.scalar import Moment
from merchantry.plans.audit import capture_changes

PART = "key_part"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def save_in_parts(df: DataFrame, key: str, path: str, parts: int = 1024) -> None:
    """Write a snapshot as `rows`, partitioned by a hash of its key, and the `digests` of its parts.

    The digests are computed from the written rows, so they say what the files hold. A part that
    has no rows has no digest. Column names and types count, so that a snapshot with other columns
    differs everywhere.
    """
    spark = df.sparkSession
    df.withColumn(PART, _part(key, parts)).hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(
        f"{path}/rows"
    )
    stored = spark.read.schema(f"{df.schema.toDDL()}, {PART} int").parquet(f"{path}/rows")
    shape = F.lit(f"{parts} {key} {df.schema.simpleString()}")
    names = [F.when(F.col(c).isNull(), c).otherwise("") for c in df.columns]  # the hash skips NULL
    row = F.xxhash64(shape, *names, *df.columns).cast("decimal(38,0)")
    stored.groupBy(PART).agg(F.count("*").alias("n"), F.sum(row).alias("digest")).write.mode("overwrite").parquet(
        f"{path}/digests"
    )


def differing_parts(spark: SparkSession, old: str, new: str) -> list[int]:
    """Parts of two stored snapshots that are not surely equal: at most as many as a snapshot has parts."""
    a, b = (spark.read.parquet(f"{path}/digests") for path in (old, new))
    same = a.join(b, [PART, "n", "digest"], "inner").select(PART)
    every = a.select(PART).union(b.select(PART)).distinct()
    return sorted(r[PART] for r in every.join(same, PART, "left_anti").collect())


def stored_changes(
    spark: SparkSession,
    old: str,
    new: str,
    key: str,
    table: str,
    as_of: Moment,
    context: Mapping[str, str | None] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Audit rows for the difference of two stored snapshots; only files of differing parts are read.

    The same rows as `capture_changes` over the whole snapshots, but for sums of 64-bit hashes that
    agree by chance.
    """
    parts = differing_parts(spark, old, new)
    sides = [spark.read.parquet(f"{path}/rows").where(F.col(PART).isin(parts)).drop(PART) for path in (old, new)]
    return capture_changes(*sides, key, table, as_of, context, exclude)
