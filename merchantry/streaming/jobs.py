"""Incremental jobs: windowed activity, running quality, daily recompute and extract.

All run with `availableNow` by default: they take in what has arrived since the checkpoint
and stop. Windowed jobs use update mode into an upsert, so open windows are written as they
grow and a batch that is retried writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merchantry.functions.scalar import Moment, moment
from merchantry.plans.monitoring import quality_counts, quality_rates
from merchantry.plans.refresh import YEAR, by_year
from merchantry.plans.sales import DAY, daily_sales_summary, with_emptied_days
from merchantry.sources.shared import discard, path_exists, shared_dir, written
from merchantry.sources.sinks import upsert_table


def _event_time(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """Watermarks need an instant; the column is read as time of the session zone (UTC)."""
    return stream.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", lateness)


def _run(
    result: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str
) -> StreamingQuery:
    return (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _upsert_windows(out: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, _: int) -> None:
        rows = batch.select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"), *[c for c in batch.columns if c != "window"]
        ).withColumn("window_month", F.date_format("window_start", "yyyy-MM"))
        # computed once, in storage that outlives an executor
        path = shared_dir(batch.sparkSession, "batch")
        try:
            rows = written(rows, "batch", path)
            # a batch that only moves the watermark carries no rows
            if not rows.isEmpty():
                upsert_table(batch.sparkSession, out, rows, ["window_start", *keys], partition_by=["window_month"])
        finally:
            discard(batch.sparkSession, path)

    return write


def activity_counts(
    stream: DataFrame,
    time_column: str,
    kind: str,
    out: str,
    checkpoint: str,
    width: str = "1 hour",
    lateness: str = "7 days",
) -> StreamingQuery:
    """Rows per tumbling window and kind, kept up to date in a table partitioned by month."""
    counts = (
        _event_time(stream, time_column, lateness)
        .groupBy(F.window("_at", width).alias("window"), kind)
        .agg(F.count("*").alias("changes"))
    )
    return _run(counts, _upsert_windows(out, [kind]), checkpoint, "update")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a finished run left out because they were older than its watermark.

    They are missing in the windows until `repair_activity` counts those again. Spark keeps the
    last 100 updates of a run only (`spark.sql.streaming.numRecentProgressUpdates`); a run of
    more batches has dropped at least so many.
    """
    return sum(
        int(state["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def repair_activity(
    events: DataFrame, time_column: str, kind: str, out: str, since: Moment, until: Moment, width: str = "1 hour"
) -> None:
    """Count the windows between two times from the whole event table and upsert them.

    This is the way for rows that came too late for the stream, as a nightly job over the last
    days. The times must be window bounds.
    """
    at = F.col(time_column)
    span = events.where((at >= moment(since)) & (at < moment(until)))
    counts = span.groupBy(F.window(at, width).alias("window"), kind).agg(F.count("*").alias("changes"))
    _upsert_windows(out, [kind])(counts, 0)


def running_quality(
    stream: DataFrame,
    time_column: str,
    slow_threshold: float,
    out: str,
    checkpoint: str,
    width: str = "1 hour",
    lateness: str = "7 days",
) -> StreamingQuery:
    """Totals, error and slow rates per window; needs `duration` and `is_error` columns."""
    counts = (
        _event_time(stream, time_column, lateness)
        .groupBy(F.window("_at", width).alias("window"))
        .agg(*quality_counts(slow_threshold))
        .select("window", *quality_rates())
    )
    return _run(counts, _upsert_windows(out, []), checkpoint, "update")


def daily_refresh(
    changed_orders: DataFrame,
    orders: Callable[[], DataFrame],
    customers: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    as_of: Moment,
    lateness_days: int | None = None,
) -> StreamingQuery:
    """Recompute the days that new orders fall on, from the whole order table, and upsert them.

    `orders` and `customers` return the tables as they stand when a batch runs. With
    `lateness_days` only days that close to the batch's newest day are recomputed, as a
    nightly job over the last days would; without it every changed day is.
    """

    def write(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("created_at").alias("_day")).distinct()
        span = days.agg(F.min("_day").alias("first"), F.max("_day").alias("last")).first()
        if span["last"] is None:
            return
        first = span["first"]
        if lateness_days is not None:
            first = max(first, span["last"] - timedelta(days=lateness_days))
        # the range reaches the scan; the semi join then keeps the changed days only
        ranged = orders().where(
            (F.col("created_at") >= moment(first)) & (F.col("created_at") < moment(span["last"] + timedelta(days=1)))
        )
        affected = ranged.join(days, F.to_date("created_at") == F.col("_day"), "left_semi")
        fresh = daily_sales_summary(affected, customers(), as_of)
        if path_exists(batch.sparkSession, out):
            changed = days.where(F.col("_day") >= F.lit(first)).select(F.col("_day").alias(DAY))
            stored = batch.sparkSession.read.parquet(out).select(DAY).join(changed, DAY, "left_semi")
            fresh = with_emptied_days(fresh, stored, as_of)
        upsert_table(batch.sparkSession, out, by_year(fresh), [DAY], partition_by=[YEAR])

    return _run(changed_orders, write, checkpoint, "append")


def incremental_extract(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what arrived since the checkpoint. The file sink's log keeps a retried batch
    from being written twice."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
