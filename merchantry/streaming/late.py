"""Windowed summaries of a stream that lose no row, however late it comes.

A watermark bounds what a stream keeps in memory by dropping rows behind it. Here the sums of a
day's windows lie in files instead, one version for each micro-batch that touched the day, so no
row has to be dropped: a batch reads the days it touches, adds its own sums and writes them again.
Rows behind the watermark go to a table of their own as well, and repair their windows like any
others.

    state/batch=17/day=2024-01-10    sums of all windows of the day, after batch 17
    late/batch=17                    rows of batch 17 that were behind the watermark
    marks/17.json                    newest time up to batch 17, its rows in time and late, and for
                                     every day the batch that holds its last version

The mark is the last file of a batch. A batch that is retried reads what the marks of earlier
batches name and overwrites its own files, so it ends with the same tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from merchantry.plans.monitoring import quality_counts, quality_rates
from merchantry.sources.shared import Scratch, discard, file_system, path_exists

WEEK = timedelta(days=7)
START, DAY, BATCH = "window_start", "day", "batch"
MARKS = "batch bigint, newest timestamp_ntz, in_time bigint, late bigint, undated bigint"


def _put(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file whole: under another name first, then renamed."""
    fs, target = file_system(spark, path)
    part = target.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(content, "utf-8"))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


class WindowedState:
    """Sums per tumbling window and key, kept exact in files below one folder.

    `sums` are aggregates that add up, such as counts and sums. Windows must divide a day. A row
    whose time is NULL belongs to no window; the marks count such rows as undated. A row is late
    if its time is more than `lateness` before the newest time of all earlier batches.
    """

    def __init__(
        self,
        path: str,
        time_column: str,
        keys: Sequence[str],
        sums: Sequence[Column],
        width: str = "1 hour",
        lateness: timedelta = WEEK,
    ) -> None:
        self.path, self.keys, self.sums = path, list(keys), list(sums)
        self.at = F.col(time_column).cast("timestamp_ntz")
        self.width, self.lateness = width, lateness

    def _mark(self, spark: SparkSession, before: int | None = None) -> dict:
        """What the last complete batch (before a number) left; empty if there is none."""
        fs, folder = file_system(spark, f"{self.path}/marks")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[: -len(".json")]) for n in names if n.endswith(".json")]
        if before is not None:
            done = [n for n in done if n < before]
        if not done:
            return {BATCH: None, "newest": None, "days": {}}
        text = spark.read.text(f"{self.path}/marks/{max(done)}.json").first()["value"]
        return json.loads(text)

    def _stored(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.path}/state/{BATCH}={batch}/{DAY}={day}" for day, batch in sorted(versions.items())]
        return spark.read.parquet(*paths) if paths else None

    def _summed(self, batch: DataFrame, behind: Column) -> DataFrame:
        """One row per window and key of a batch, with its late rows and its newest time."""
        grouped = batch.groupBy(F.window(self.at, self.width).alias("_window"), *self.keys).agg(
            *self.sums, F.count("*").alias("_rows"), F.count_if(behind).alias("_late"), F.max(self.at).alias("_newest")
        )
        start = F.col("_window.start").cast("timestamp_ntz").alias(START)
        return grouped.select(start, *[c for c in grouped.columns if c != "_window"])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch; the same call again leaves the same tables."""
        spark = batch.sparkSession
        mark = self._mark(spark, batch_id)
        newest = datetime.fromisoformat(mark["newest"]) if mark["newest"] else None
        behind = F.lit(False)
        if newest is not None:
            behind = self.at < F.lit(newest - self.lateness).cast("timestamp_ntz")
        with Scratch(spark, "arrived") as scratch:
            summed = scratch.written(self._summed(batch.where(self.at.isNotNull()), behind), "summed")
            found = summed.groupBy(F.date_format(START, "yyyy-MM-dd").alias(DAY)).agg(
                F.sum("_rows").alias("rows"), F.sum("_late").alias("late"), F.max("_newest").alias("newest")
            ).collect()
            undated = batch.where(self.at.isNull()).count()
            late = sum(r["late"] for r in found)
            if late:
                batch.where(behind).write.mode("overwrite").parquet(f"{self.path}/late/{BATCH}={batch_id}")
            days = {r[DAY] for r in found}
            if days:
                stored = self._stored(spark, {d: b for d, b in mark["days"].items() if d in days})
                self._grown(summed.drop("_rows", "_late", "_newest"), stored).write.mode("overwrite").partitionBy(
                    DAY
                ).parquet(f"{self.path}/state/{BATCH}={batch_id}")
        times = [r["newest"] for r in found] + ([newest] if newest else [])
        own = {
            BATCH: batch_id,
            "newest": max(times).isoformat() if times else None,
            "in_time": sum(r["rows"] for r in found) - late,
            "late": late,
            "undated": undated,
            "days": {**mark["days"], **dict.fromkeys(sorted(days), batch_id)},
        }
        _put(spark, f"{self.path}/marks/{batch_id}.json", json.dumps(own))
        self._forget(spark, mark)

    def _grown(self, fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
        """The windows of the touched days with a batch's sums added, gathered by day."""
        both = fresh
        if stored is not None:
            same = [START, *self.keys]
            both = stored.select(fresh.columns).unionByName(fresh).groupBy(*same).agg(
                *[F.sum(f.name).cast(f.dataType).alias(f.name) for f in fresh.schema if f.name not in same]
            )
        return both.withColumn(DAY, F.date_format(START, "yyyy-MM-dd")).hint("rebalance", DAY)

    def _forget(self, spark: SparkSession, mark: dict) -> None:
        """Remove the versions that the last but one batch still had and the last replaced.

        The last batch's own are kept, as its successor may be retried.
        """
        if mark[BATCH] is None:
            return
        older = self._mark(spark, mark[BATCH])["days"]
        for day, batch in older.items():
            if mark["days"].get(day) != batch:
                discard(spark, f"{self.path}/state/{BATCH}={batch}/{DAY}={day}")

    def windows(self, spark: SparkSession) -> DataFrame:
        """All windows as the last complete batch left them."""
        found = self._stored(spark, self._mark(spark)["days"])
        if found is None:
            raise ValueError("no dated row has been taken in yet")
        return found

    def marks(self, spark: SparkSession) -> DataFrame:
        """Per batch the newest time and the rows in time, late and undated, over all batches ever."""
        return spark.read.schema(MARKS).json(f"{self.path}/marks")

    def late_rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows that came behind the watermark, with the number of their batch."""
        path = f"{self.path}/late"
        if not path_exists(spark, path):
            return spark.createDataFrame([], f"{schema}, {BATCH} int")
        return spark.read.schema(f"{schema}, {BATCH} int").parquet(path)


def _run(stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
    )


def activity_state(path: str, time_column: str, kind: str, width: str = "1 hour", lateness: timedelta = WEEK) -> WindowedState:
    """Rows per window and kind."""
    return WindowedState(path, time_column, [kind], [F.count("*").alias("changes")], width, lateness)


def quality_state(
    path: str, time_column: str, slow_threshold: float, width: str = "1 hour", lateness: timedelta = WEEK
) -> WindowedState:
    """Totals per window of which `running_quality` derives the rates; needs `duration` and `is_error`."""
    return WindowedState(path, time_column, [], quality_counts(slow_threshold), width, lateness)


def running_quality(state: WindowedState, spark: SparkSession) -> DataFrame:
    """Totals, error and slow rates per window of a `quality_state`."""
    return state.windows(spark).select(START, *quality_rates())


def keep_exact(stream: DataFrame, state: WindowedState, checkpoint: str) -> StreamingQuery:
    """Take what has arrived since the checkpoint into the state, late rows included, and stop."""
    return _run(stream, state.add, checkpoint)
