"""Retention of a stored audit log: partitions by table and month are dropped whole, one is rewritten."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from merchantry.functions.scalar import Moment, moment, year_month
from merchantry.operators.joins import small_side
from merchantry.plans.audit import apply_retention
from merchantry.rules import Rules
from merchantry.sources.shared import discard
from merchantry.sources.sinks import load

TABLE, MONTH = "log_table", "log_month"


def save_log(log: DataFrame, path: str, method: str = "append") -> None:
    """Store audit rows by table and month. Rows without a time have a partition of their own, which
    the next `expire` drops, as no retention keeps them."""
    load(log.withColumns({TABLE: F.col("table_name"), MONTH: year_month("changed_at")}), path, method, [TABLE, MONTH])


def stored_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows with their partition columns, which are text whatever they look like."""
    parts = StructType([*schema.fields]).add(TABLE, "string").add(MONTH, "string")
    return spark.read.schema(parts).parquet(path)


def _is(parts: list[Row]) -> Column:
    same = [F.col(TABLE).eqNullSafe(F.lit(p[TABLE])) & F.col(MONTH).eqNullSafe(F.lit(p[MONTH])) for p in parts]
    return reduce(or_, same, F.lit(False))


def _drop(spark: SparkSession, path: str, part: Row) -> None:
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    names = [escaped.getPartitionPathString(c, part[c]) for c in (TABLE, MONTH)]
    discard(spark, "/".join([path, *names]))


def expire(
    spark: SparkSession, path: str, schema: StructType, config: DataFrame, as_of: Moment, rules: Rules
) -> dict[str, int]:
    """Remove the rows of a stored log that are out of their table's retention.

    Months before the one that a table's retention reaches into are dropped by name, without
    reading a value. Of the month it ends in only the kept rows are written again, and nothing
    if all stay; no other file is touched. The list of partitions, tables times months, is what
    the driver sees. Returns how many partitions were dropped and rewritten. Lost tasks and
    executors are repeated before any file is replaced. A driver lost while the commit swaps the
    files of a rewritten month can lose that month's kept rows, so keep a copy until the call
    returns; and no other job may write to the log meanwhile.
    """
    log = stored_log(spark, path, schema)
    limits = config.select(F.col("table_name").alias("_table"), F.col("retention_days").alias("_days"))
    days = F.coalesce(F.col("_days"), F.lit(rules.audit_retention_days))
    edge = year_month(moment(as_of) - F.make_dt_interval(days=days))
    parts = log.select(TABLE, MONTH).distinct()
    judged = parts.join(small_side(limits), F.col(TABLE) == F.col("_table"), "left").select(
        TABLE, MONTH, F.when(F.col(MONTH) >= edge, F.col(MONTH) == edge).alias("ends_here")
    )
    found = judged.where("ends_here IS NULL OR ends_here").collect()
    expired, boundary = ([p for p in found if bool(p["ends_here"]) == b] for b in (False, True))
    touched = log.where(_is(boundary))
    kept = apply_retention(touched, config, as_of, rules)
    left = {(r[TABLE], r[MONTH]): r["n"] for r in kept.groupBy(TABLE, MONTH).agg(F.count("*").alias("n")).collect()}
    had = {(r[TABLE], r[MONTH]): r["n"] for r in touched.groupBy(TABLE, MONTH).agg(F.count("*").alias("n")).collect()}
    expired += [p for p in boundary if (p[TABLE], p[MONTH]) not in left]
    rewritten = [p for p in boundary if 0 < left.get((p[TABLE], p[MONTH]), 0) < had[p[TABLE], p[MONTH]]]
    if rewritten:
        writer = kept.where(_is(rewritten)).hint("rebalance", TABLE, MONTH).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(TABLE, MONTH).parquet(path)
    for part in expired:
        _drop(spark, path, part)
    return {"dropped": len(expired), "rewritten": len(rewritten)}
