"""Load modes: replace, append and the column-wise upsert."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators.joins import few, small_side
from merchantry.operators.ordering import latest_per_key
from merchantry.sources.shared import discard, file_system, path_exists, shared_dir, written

SMALL_SOURCE_ROWS = 10_000
MODES = {"replace": "overwrite", "append": "append"}


def load(df: DataFrame, path: str, method: str, partition_by: Sequence[str] = ()) -> None:
    """`replace` empties the table first, `append` adds all rows.

    Rows of a partitioned table are gathered by partition before the write, which keeps the
    files few; adaptive execution splits a partition that is too large for one task.
    """
    if method not in MODES:
        raise ValueError(f"load method must be one of {sorted(MODES)}, or use upsert_table")
    gathered = df.hint("rebalance", *partition_by) if partition_by else df
    gathered.write.mode(MODES[method]).partitionBy(*partition_by).parquet(path)


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str | None = None, method: str = "replace"
) -> None:
    """A catalog table whose files are bucketed and sorted by one key.

    Jobs that join or group such tables by the key, like orders and their items by order,
    read them in place instead of shuffling them. Both sides need the same bucket count, and
    the key should have no dominating value, as all rows of a value share a bucket. The rows are spread by the key first, so that a bucket is one file and not one per task.
    """
    writer = df.repartition(buckets, key).write.mode(MODES[method]).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    small_source: bool = False,
) -> DataFrame:
    """Target after the source rows are inserted or, on a key clash, overwrite their columns.

    Only columns that the source supplies change, and a supplied NULL wins. Source columns
    unknown to the target are dropped; target columns unknown to the source become NULL in
    new rows. `order_by` names the columns whose last row counts when the source repeats a
    key; without it the source must hold each key once.

    Both sides meet in a full outer join by key. With `small_source`, for a source whose row
    count was checked, it is broadcast instead and the target is not shuffled at all.
    """
    if not keys:
        raise ValueError("an upsert needs its key columns")
    supplied = [c for c in source.columns if c in target.columns]
    missing = [k for k in keys if k not in supplied]
    if missing:
        raise ValueError(f"key column(s) not on both sides: {missing}")
    if order_by:
        source = latest_per_key(source, keys, order_by)
    fresh = source.select(
        *[F.col(c).cast(target.schema[c].dataType).alias(f"_new_{c}") for c in supplied],
        F.lit(True).alias("_given"),
    )
    same = reduce(and_, [F.col(k) == F.col(f"_new_{k}") for k in keys])
    result = [
        F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c)
        for c in target.columns
    ]
    if not small_source:
        return target.join(fresh, same, "full_outer").select(*result)
    known = target.select(*keys).join(F.broadcast(fresh.select(*[f"_new_{k}" for k in keys])), same, "left_semi")
    added = fresh.join(F.broadcast(known.distinct()), same, "left_anti")
    blanks = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c not in supplied]
    inserted = added.select(*[F.col(f"_new_{c}").alias(c) for c in supplied], *blanks)
    return target.join(F.broadcast(fresh), same, "left").select(*result).unionByName(inserted)


def _recover(spark: SparkSession, path: str) -> None:
    """Bring the old table back when a swap was cut off between its two renames."""
    fs, live = file_system(spark, path)
    old = live.suffix("__replaced")
    if not fs.exists(live) and fs.exists(old):
        fs.rename(old, live)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the written table `fresh` in the place of `path`; a failure leaves one of them whole."""
    fs, live = file_system(spark, path)
    old = live.suffix("__replaced")
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(live) and not fs.rename(live, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), live):
        raise OSError(f"cannot put {fresh} in place of {path}")
    if fs.exists(old):
        fs.delete(old, True)


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> None:
    """Upsert into a Parquet table; the first upsert creates it.

    With `partition_by` only the partitions that the source touches are read, merged and
    overwritten; the partition columns must follow from the key. Without it the whole table
    is written anew beside the old one and put in its place. Running the same upsert twice
    gives the same table, so a retried batch does no harm.
    """
    _recover(spark, path)
    if not path_exists(spark, path):
        first = latest_per_key(source, keys, order_by) if order_by else source
        load(first, path, "replace", partition_by)
        return
    # written down once: the source is read three times, and the merge reads what it replaces
    staged = [shared_dir(spark, f"upsert-{part}") for part in ("source", "merge")]
    try:
        given = written(source, "upsert", staged[0])
        target = spark.read.parquet(path)
        if not partition_by:
            fresh = f"{path.rstrip('/')}__{uuid.uuid4().hex}"  # beside the table: renamed, not copied
            staged.append(fresh)
            small = few(given, SMALL_SOURCE_ROWS)  # from the file footers
            merge_upsert(target, given, keys, order_by, small_source=small).write.parquet(fresh)
            _swap(spark, fresh, path)
            return
        touched = given.select(*partition_by).distinct()
        target = target.join(small_side(touched, SMALL_SOURCE_ROWS), [*partition_by], "left_semi")
        merged = written(merge_upsert(target, given, keys, order_by), "upsert", staged[1])
        (
            merged.hint("rebalance", *partition_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_by)
            .parquet(path)
        )
    finally:
        for folder in staged:
            discard(spark, folder)
