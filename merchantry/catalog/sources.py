"""Sources and sinks (S) and the streaming jobs (T), checked by reading back what they wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.catalog.model_sql import NOW, R, segment_sql
from merchantry.catalog.registry import AS_OF, CTES, query, sql_mean, sql_mean_money, sql_rate
from merchantry.operators.joins import same_keys
from merchantry.plans import customers, sales
from merchantry.schemas import AUDIT_CONFIG
from merchantry.sources.adapter import Model
from merchantry.sources.shared import discard, shared_dir
from merchantry.sources.sinks import load, merge_upsert
from merchantry.sources.snapshot import advanced, changes_since, export_snapshot, store_position, stored_position
from merchantry.sources.tables import load_tables, stream_table
from merchantry.streaming import jobs
from merchantry.streaming.late import WindowedState, activity_state, keep_exact, quality_state, running_quality

RECENT_DAYS = 2200
SLOW = 100


def audit_config(m: Model) -> DataFrame:
    """Switches and retention for three of the four logged tables; the fourth has no entry."""
    return m.spark.createDataFrame(
        [
            ("orders", True, True, True, False, None, 7),
            ("order_items", True, True, False, True, ["value"], 14),
            ("products", False, True, True, True, None, 21),
        ],
        AUDIT_CONFIG,
    )


CTES["v_config"] = """
  SELECT * FROM (VALUES ('orders', true, true, true, false, false, 7),
    ('order_items', true, true, false, true, true, 14), ('products', false, true, true, true, false, 21))
  AS t(table_name, is_enabled, audit_inserts, audit_updates, audit_deletes, hides_value, retention_days)"""

CTES["j_recent"] = f"""
  SELECT *, {segment_sql("total_orders", "days_since_last_order", "total_spent")} AS customer_segment FROM (
    SELECT c.customer_id, c.email AS customer_email, c.first_name || ' ' || c.last_name AS customer_name,
      count(o.order_id) AS total_orders,
      CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2)) AS total_spent,
      {sql_mean_money("sum(o.total_amount)", "count(o.total_amount)")} AS avg_order_value,
      min(o.total_amount) AS min_order_value, max(o.total_amount) AS max_order_value,
      min(o.created_at) AS first_order_date, max(o.created_at) AS last_order_date,
      CAST(date_diff('day', max(o.created_at), {NOW}) AS BIGINT) AS days_since_last_order,
      {NOW} AS last_calculated_at
    FROM m_customers c LEFT JOIN m_live o ON c.customer_id = o.customer_id
    WHERE c.created_at >= {NOW} - INTERVAL {RECENT_DAYS} DAY
    GROUP BY c.customer_id, c.email, c.first_name, c.last_name)"""


@query("s1_load_tables", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(m: Model) -> DataFrame:
    return load_tables(m.spark, m.directory, ["supplier"])["supplier"]


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query(
    "s1_load_every_table",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
)
def _(m: Model) -> DataFrame:
    loaded = load_tables(m.spark, m.directory, _TABLES)
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in loaded.items()]
    return reduce(DataFrame.unionAll, counts)


@query("s2_replace_load", "SELECT * FROM j_daily")
def _(m: Model) -> DataFrame:
    out = shared_dir(m.spark, "replace")
    daily = sales.daily_sales_summary(m.orders, m.customers, AS_OF)
    early = m.orders.where(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))
    load(sales.daily_sales_summary(early, m.customers, AS_OF), out, "replace")
    load(daily, out, "replace")
    return m.spark.read.schema(daily.schema).parquet(out)


@query("s3_append_load", "SELECT order_id, order_number, order_status, total_amount, created_at FROM m_orders")
def _(m: Model) -> DataFrame:
    out = shared_dir(m.spark, "append")
    orders = m.orders.select("order_id", "order_number", "order_status", "total_amount", "created_at")
    delivered = F.col("order_status") == "delivered"
    load(orders.where(delivered), out, "append")
    load(orders.where(~delivered), out, "append")
    return m.spark.read.schema(orders.schema).parquet(out)


_SUPPLIED = [
    "total_orders",
    "total_spent",
    "avg_order_value",
    "customer_segment",
    "last_order_date",
]


@query(
    "s4_merge_upsert",
    f"""SELECT coalesce(s.customer_id, t.customer_id) AS customer_id,
      {", ".join(f"CASE WHEN s.customer_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _SUPPLIED)},
      t.total_products_purchased, t.lifetime_value_tier
    FROM (SELECT * FROM j_line_summary WHERE customer_created_date < CAST({NOW} - INTERVAL 1000 DAY AS DATE)) t
      FULL OUTER JOIN j_recent s ON s.customer_id = t.customer_id""",
)
def _(m: Model) -> DataFrame:
    """Old line-grain rows of early customers, overwritten and extended by the recent summary."""
    early = m.customers.where(F.to_date("created_at") < F.to_date(F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 1000 DAYS")))
    target = customers.customer_order_summary_line_grain(early, m.orders, m.order_items, AS_OF, R)
    source = customers.recent_customer_summary(m.customers, m.orders, AS_OF, R, RECENT_DAYS)
    merged = merge_upsert(target, source, ["customer_id"])
    return merged.select("customer_id", *_SUPPLIED, "total_products_purchased", "lifetime_value_tier")


_EXPORTED = ["orders", "order_items", "products", "customers"]


@query(
    "s5_export_snapshot",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows_written, true AS verified FROM {source}"
        for name, source in zip(_EXPORTED, ["orders", "lineitem", "part", "customer"], strict=True)
    ),
)
def _(m: Model) -> DataFrame:
    rows = []
    for name in _EXPORTED:
        path = shared_dir(m.spark, f"snapshot-{name}")
        try:
            copy = export_snapshot(getattr(m, name), path)  # counts what it reads back
        finally:
            discard(m.spark, path)
        rows.append((name, copy.rows, copy.verified))
    return m.spark.createDataFrame(rows, "table_name string, rows_written bigint, verified boolean")


@query(
    "s6_incremental_extract",
    "SELECT event_id, logged_at, pattern, duration FROM m_log WHERE logged_at > TIMESTAMP '2024-01-15 12:00:00'",
)
def _(m: Model) -> DataFrame:
    """The second extract: the first one stored how far it came."""
    position = shared_dir(m.spark, "position")
    seen = m.log.where(F.col("logged_at") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    store_position(m.spark, position, advanced(seen, "logged_at", "event_id", None))
    last = stored_position(m.spark, position)
    rows = changes_since(m.log, "logged_at", last.time, "event_id", last.key)
    return rows.select("event_id", "logged_at", "pattern", "duration")


@query(
    "s7_seed_rows",
    """SELECT c.table_name, c.retention_days, count(a.id) AS logged
    FROM v_config c LEFT JOIN m_audit a ON c.table_name = a.table_name GROUP BY ALL""",
)
def _(m: Model) -> DataFrame:
    counts = m.audit_log.groupBy("table_name").agg(F.count("id").alias("logged"))
    seeds = audit_config(m).select("table_name", "retention_days")
    return seeds.join(counts, "table_name", "left").fillna(0, ["logged"])


# ---- streaming --------------------------------------------------------------------------


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query(
    "t1_activity_counts",
    """SELECT date_trunc('hour', changed_at) AS window_start, operation, count(*) AS changes
    FROM m_audit GROUP BY 1, 2""",
)
def _(m: Model) -> DataFrame:
    out, checkpoint = shared_dir(m.spark, "activity"), shared_dir(m.spark, "activity-state")
    stream = m.streaming("events").audit_log
    _finished(jobs.activity_counts(stream, "changed_at", "operation", out, checkpoint))
    return m.spark.read.parquet(out).drop("window_month")


CTES["v_quality"] = f"""
  SELECT *, CASE WHEN total_queries > 0 THEN {sql_mean("d", "total_queries")} ELSE 0.0 END AS average_execution_time,
    {sql_rate("errors", "total_queries")} AS error_rate, {sql_rate("slow_queries", "total_queries")} AS slow_query_rate
  FROM (SELECT date_trunc('hour', logged_at) AS window_start, count(*) AS total_queries,
      count(*) FILTER (duration > {SLOW}) AS slow_queries, count(*) FILTER (is_error) AS errors, sum(duration) AS d
    FROM m_log GROUP BY 1)"""


@query("t2_running_quality", "SELECT * EXCLUDE (d) FROM v_quality")
def _(m: Model) -> DataFrame:
    out, checkpoint = shared_dir(m.spark, "quality"), shared_dir(m.spark, "quality-state")
    _finished(jobs.running_quality(m.streaming("events").log, "logged_at", SLOW, out, checkpoint))
    return m.spark.read.parquet(out).drop("window_month")


@query("t3_incremental_daily_upsert", "SELECT * FROM j_daily")
def _(m: Model) -> DataFrame:
    out, checkpoint = shared_dir(m.spark, "daily"), shared_dir(m.spark, "daily-state")
    stream = m.streaming("orders").orders
    _finished(jobs.daily_refresh(stream, lambda: m.orders, lambda: m.customers, out, checkpoint, AS_OF))
    return m.spark.read.parquet(out).drop("summary_year")


ARRIVALS = 4
# the newest time of all earlier arrivals decides whether a row is late
LATE_SQL = """(SELECT *, coalesce({at} < newest - INTERVAL 7 DAY, false) AS is_late
    FROM (SELECT *, {id} % 4 AS arrival FROM {table}) r
    LEFT JOIN (SELECT s AS arrival, (SELECT max({at}) FROM {table} WHERE {id} % 4 < s) AS newest FROM range(4) t(s)) a
      USING (arrival))"""


def _arrived(m: Model, rows: DataFrame, number: str, state: WindowedState) -> None:
    """Let the rows of a table arrive in four parts, dealt by their number, as four runs of a stream."""
    folder, checkpoint = shared_dir(m.spark, "arrivals"), shared_dir(m.spark, "arrivals-state")
    for part in range(ARRIVALS):
        rows.where(F.pmod(F.col(number), F.lit(ARRIVALS)) == part).write.mode("append").parquet(folder)
        _finished(keep_exact(stream_table(m.spark, folder, rows.schema), state, checkpoint))


@query(
    "t1_late_activity",
    f"""SELECT date_trunc('hour', changed_at) AS window_start, operation, count(*) AS changes,
      count(*) FILTER (is_late) AS late_rows
    FROM {LATE_SQL.format(at="changed_at", id="id", table="m_audit")} GROUP BY 1, 2""",
)
def _(m: Model) -> DataFrame:
    """Three of four arrivals lie mostly behind the watermark; every window is whole all the same."""
    rows = m.audit_log.select("id", "changed_at", "operation")
    state = activity_state(shared_dir(m.spark, "late-activity"), "changed_at", "operation")
    _arrived(m, rows, "id", state)
    late = state.late_rows(m.spark, "id bigint, changed_at timestamp_ntz, operation string")
    hours = late.groupBy(F.date_trunc("hour", "changed_at").cast("timestamp_ntz").alias("_hour"), F.col("operation").alias("_kind"))
    counts = hours.agg(F.count("*").alias("late_rows"))
    joined = state.windows(m.spark).join(counts, same_keys(["window_start", "operation"], ["_hour", "_kind"]), "left")
    return joined.select("window_start", "operation", "changes", F.coalesce("late_rows", F.lit(0)).alias("late_rows"))


@query("t2_late_quality", "SELECT * EXCLUDE (d) FROM v_quality")
def _(m: Model) -> DataFrame:
    rows = m.log.select("event_id", "logged_at", "duration", "is_error")
    state = quality_state(shared_dir(m.spark, "late-quality"), "logged_at", SLOW)
    _arrived(m, rows, "event_id", state)
    return running_quality(state, m.spark)


@query(
    "t4_incremental_extract",
    "SELECT event_id, logged_at, user_id, pattern, duration, is_error FROM m_log",
)
def _(m: Model) -> DataFrame:
    out, checkpoint = shared_dir(m.spark, "extract"), shared_dir(m.spark, "extract-state")
    stream = m.streaming("events").log.select("event_id", "logged_at", "user_id", "pattern", "duration", "is_error")
    _finished(jobs.incremental_extract(stream, out, checkpoint))
    return m.spark.read.schema(stream.schema).parquet(out)


