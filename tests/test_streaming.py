"""Streams that get their files in several steps, compared with the batch result."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry import schemas
from merchantry.plans import sales
from merchantry.sources.tables import stream_table
from merchantry.streaming import jobs
from tests.test_customers import order

EVENTS = "at timestamp_ntz, kind string, duration decimal(18,2), is_error boolean"


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture
def folder(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "out", "state")}


def test_activity_over_three_arrivals(spark, rows, folder):
    steps = [
        [(datetime(2024, 1, 1, 10, 5), "a"), (datetime(2024, 1, 1, 10, 59), "a"), (datetime(2024, 1, 1, 11, 0), "b")],
        [(datetime(2024, 1, 1, 10, 30), "a"), (datetime(2024, 2, 2, 0, 0), "b")],
        # older than the watermark of seven days: no longer counted
        [(datetime(2024, 1, 1, 10, 30), "a"), (datetime(2024, 2, 1, 23, 0), "b")],
    ]
    for step in steps:
        spark.createDataFrame([(*r, D(1), False) for r in step], EVENTS).coalesce(1).write.mode("append").parquet(folder["in"])
        stream = stream_table(spark, folder["in"], EVENTS)
        query = jobs.activity_counts(stream, "at", "kind", folder["out"], folder["state"])
        finish(query)
    assert jobs.dropped_rows(query) == 1
    assert rows(spark.read.parquet(folder["out"]), "window_start", "kind", "changes") == [
        (datetime(2024, 1, 1, 10), "a", 3),
        (datetime(2024, 1, 1, 11), "b", 1),
        (datetime(2024, 2, 1, 23), "b", 1),
        (datetime(2024, 2, 2, 0), "b", 1),
    ]
    events = spark.read.schema(EVENTS).parquet(folder["in"])
    jobs.repair_activity(events, "at", "kind", folder["out"], "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    batch = events.groupBy(F.date_trunc("hour", "at").cast("timestamp_ntz").alias("h"), "kind").count()
    assert rows(spark.read.parquet(folder["out"]), "window_start", "kind", "changes") == rows(batch)


def test_running_quality(spark, rows, folder):
    at = datetime(2024, 1, 1, 10, 5)
    for batch in ([(at, "a", D(5), True), (at, "a", D(1), False)], [(at, "a", D(9), False), (at, "a", D(1), False)]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(folder["in"])
        finish(jobs.running_quality(stream_table(spark, folder["in"], EVENTS), "at", 4, folder["out"], folder["state"]))
    found = rows(spark.read.parquet(folder["out"]).drop("window_month", "window_start"))
    assert found == [(4, 2, 1, 4.0, 25.0, 50.0)]


@pytest.mark.parametrize("lateness", [None, 7])
def test_daily_refresh(spark, rows, folder, lateness):
    people = spark.createDataFrame([(1, datetime(2024, 1, 1))], "customer_id bigint, created_at timestamp_ntz")
    now = "2024-02-01 00:00:00"

    def arrive(*orders):
        spark.createDataFrame(list(orders), schemas.ORDERS).coalesce(1).write.mode("append").parquet(folder["in"])
        stream = stream_table(spark, folder["in"], schemas.ORDERS)
        table = lambda: spark.read.schema(schemas.ORDERS).parquet(folder["in"])
        finish(jobs.daily_refresh(stream, table, lambda: people, folder["out"], folder["state"], now, lateness))

    arrive(order(1, 1, "10", "2024-01-10 10:00:00"), order(2, 1, "20", "2024-01-12 10:00:00"))
    arrive(order(3, 1, "5", "2024-01-10 11:00:00"), order(4, 1, "7", "2024-01-30 11:00:00"))
    got = rows(spark.read.parquet(folder["out"]).drop("summary_year"), "summary_date", "total_orders", "total_order_value")
    orders = spark.read.schema(schemas.ORDERS).parquet(folder["in"])
    batch = rows(sales.daily_sales_summary(orders, people, now), "summary_date", "total_orders", "total_order_value")
    if lateness is None:
        assert got == batch
    else:  # the tenth lies twenty days before the newest day and keeps its first figures
        assert [r[1] for r in got] == [1, 1, 1] and [r[1] for r in batch] == [2, 1, 1]


def test_refresh_equals_the_batch_after_a_cancellation(spark, rows, folder):
    """A day that loses its only order gets a row of zeros, which the batch form leaves out."""
    people = spark.createDataFrame([(1, datetime(2024, 1, 1))], "customer_id bigint, created_at timestamp_ntz")
    now = "2024-02-01 00:00:00"
    steps = [
        [order(1, 1, "10", "2024-01-10 10:00:00"), order(2, 1, "20", "2024-01-12 10:00:00")],
        [order(1, 1, "10", "2024-01-10 10:00:00", "cancelled")],
    ]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, schemas.ORDERS).coalesce(1).write.mode("append").parquet(folder["in"])
        latest = {r[0]: r for s in steps[: i + 1] for r in s}
        table = spark.createDataFrame(list(latest.values()), schemas.ORDERS)
        stream = stream_table(spark, folder["in"], schemas.ORDERS)
        finish(jobs.daily_refresh(stream, lambda t=table: t, lambda: people, folder["out"], folder["state"], now))
    got = rows(spark.read.parquet(folder["out"]), "summary_date", "total_orders", "total_order_value")
    batch = rows(sales.daily_sales_summary(table, people, now), "summary_date", "total_orders", "total_order_value")
    assert [r for r in got if r[1]] == batch
    assert [r[1:] for r in got] == [(0, D("0.00")), (1, D("20.00"))]


def test_extract_takes_each_file_once(spark, folder):
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(folder["in"])
        finish(jobs.incremental_extract(stream_table(spark, folder["in"], "id bigint", 1), folder["out"], folder["state"]))
    finish(jobs.incremental_extract(stream_table(spark, folder["in"], "id bigint"), folder["out"], folder["state"]))
    assert spark.read.parquet(folder["out"]).count() == 7
