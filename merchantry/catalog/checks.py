"""Data quality (Q), audit (A) and monitoring (N) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry import schemas
from merchantry.catalog.jobs import (
    BACKFILL_SQL,
    CHANGES_SQL,
    backfilled,
    captured,
    cohort_table,
    daily,
    performance,
    summary,
)
from merchantry.catalog.model_sql import R
from merchantry.catalog.registry import EVENTS_AS_OF, query, sql_mean, sql_rate
from merchantry.catalog.sources import SLOW, audit_config
from merchantry.functions.scalar import MONEY, TOTAL, year_month
from merchantry.operators.heavy import heavy_hitters
from merchantry.operators.joins import cascade_delete, never_used, set_null_on_delete
from merchantry.plans import audit, monitoring, quality, retention, sketches
from merchantry.schemas import DOMAINS
from merchantry.sources.adapter import Model
from merchantry.sources.shared import shared_dir, written
from merchantry.sources.tables import TABLES, load_tables

THEN = f"TIMESTAMP '{EVENTS_AS_OF}'"

# ---- data quality ---------------------------------------------------------------------------

# check name, child, foreign key, parent, parent key
KEYS = [
    ("addresses.customer_id", "addresses", "customer_id", "customers", "customer_id"),
    ("categories.parent_category_id", "categories", "parent_category_id", "categories", "category_id"),
    ("products.category_id", "products", "category_id", "categories", "category_id"),
    ("orders.customer_id", "orders", "customer_id", "customers", "customer_id"),
    ("orders.billing_address_id", "orders", "billing_address_id", "addresses", "address_id"),
    ("orders.shipping_address_id", "orders", "shipping_address_id", "addresses", "address_id"),
    ("order_items.order_id", "order_items", "order_id", "orders", "order_id"),
    ("order_items.product_id", "order_items", "product_id", "products", "product_id"),
    ("inventory_movements.product_id", "inventory_movements", "product_id", "products", "product_id"),
    ("orders.order_id in order_items", "orders", "order_id", "order_items", "order_id"),
]
SQL_NAME = {
    "customers": "m_customers",
    "addresses": "m_addresses",
    "categories": "m_categories",
    "products": "m_products",
    "orders": "m_orders",
    "order_items": "m_items",
    "inventory_movements": "m_moves",
}


@query(
    "q1_referential_integrity",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS check_name, count(*) AS orphan_rows, count(DISTINCT c.{fk}) AS orphan_keys
        FROM {SQL_NAME[child]} c WHERE c.{fk} IS NOT NULL AND c.{fk} NOT IN (SELECT {key} FROM {SQL_NAME[parent]})"""
        for name, child, fk, parent, key in KEYS
    ),
)
def _(m: Model) -> DataFrame:
    return quality.stacked(
        [quality.orphans(name, getattr(m, child), fk, getattr(m, parent), key) for name, child, fk, parent, key in KEYS]
    )


UNIQUE = [
    ("customers.email", "customers", ["email"]),
    ("categories.category_slug", "categories", ["category_slug"]),
    ("products.sku", "products", ["sku"]),
    ("products.product_slug", "products", ["product_slug"]),
    ("products.product_name", "products", ["product_name"]),
    ("orders.order_number", "orders", ["order_number"]),
    ("order_items.order_id,product_id", "order_items", ["order_id", "product_id"]),
    ("daily_sales_summary.summary_date", "daily_sales_summary", ["summary_date"]),
    ("customer_cohort_analysis.cohort_month,period_number", "cohorts", ["cohort_month", "period_number"]),
    ("audit_config.table_name", "audit_config", ["table_name"]),
]
# tables that are computed, and the SQL that holds the same rows
DERIVED = {"daily_sales_summary": daily, "cohorts": cohort_table, "audit_config": audit_config, "summary": summary}
SQL_NAME |= {
    "daily_sales_summary": "j_daily",
    "cohorts": "j_cohorts",
    "audit_config": "v_config",
    "summary": "j_summary",
    "performance": "j_perf",
    "audit_log": "m_audit",
}


def _checked(m: Model, name: str) -> DataFrame:
    if name == "performance":
        return performance(m)
    return DERIVED[name](m) if name in DERIVED else getattr(m, name)



@query(
    "q2_uniqueness",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS check_name, count(*) AS duplicate_keys,
          CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows
        FROM (SELECT count(*) AS n FROM {SQL_NAME[t]} GROUP BY {", ".join(cols)} HAVING count(*) > 1)"""
        for name, t, cols in UNIQUE
    ),
)
def _(m: Model) -> DataFrame:
    return quality.stacked(
        [quality.duplicates(name, _checked(m, t), cols, any_case=cols == ["email"]) for name, t, cols in UNIQUE]
    )


REQUIRED = {
    "customers": ["customer_id", "email", "first_name", "last_name", "created_at"],
    "addresses": ["address_id", "customer_id", "address_type", "city", "state", "country"],
    "categories": ["category_id", "category_name", "category_slug", "parent_category_id"],
    "products": ["product_id", "category_id", "sku", "product_name", "price"],
    "orders": ["order_id", "customer_id", "order_number", "subtotal", "total_amount", "shipping_address_id"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price", "total_price"],
    "inventory_movements": ["product_id", "movement_type", "quantity", "reference_id"],
}


@query(
    "q3_required_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows
        FROM {SQL_NAME[t]}"""
        for t, cols in REQUIRED.items()
        for c in cols
    ),
)
def _(m: Model) -> DataFrame:
    return quality.stacked([quality.missing_values(t, getattr(m, t), cols) for t, cols in REQUIRED.items()])


# the last entry is too narrow on purpose, so that the check finds something
CHECKED = {
    "customers": {"customer_status": DOMAINS["customer_status"]},
    "addresses": {"address_type": DOMAINS["address_type"]},
    "orders": {c: DOMAINS[c] for c in ("order_status", "payment_status")},
    "inventory_movements": {c: DOMAINS[c] for c in ("movement_type", "reference_type")},
    "audit_log": {"operation": DOMAINS["operation"]},
    "summary": {c: DOMAINS[c] for c in ("customer_segment", "lifetime_value_tier")},
    "performance": {c: DOMAINS[c] for c in ("performance_tier", "velocity_category")},
    "products": {"category_id": ["SMALL/Brand#1", "LARGE/Brand#2"]},
}


@query(
    "q4_domain",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
          count(*) FILTER ({c} NOT IN ({", ".join(repr(v) for v in members)})) AS bad_rows FROM {SQL_NAME[t]}"""
        for t, columns in CHECKED.items()
        for c, members in columns.items()
    ),
)
def _(m: Model) -> DataFrame:
    return quality.stacked([quality.outside_domain(t, _checked(m, t), d) for t, d in CHECKED.items()])


@query(
    "q5_line_arithmetic",
    """SELECT order_id, product_id, quantity, unit_price, total_price,
      CAST(total_price - quantity * unit_price AS DECIMAL(18,2)) AS difference
    FROM m_items WHERE total_price <> quantity * unit_price""",
)
def _(m: Model) -> DataFrame:
    return quality.line_arithmetic(m.order_items)


@query(
    "q6_order_arithmetic",
    """SELECT * FROM (SELECT o.order_id, CAST(o.total_amount - o.subtotal AS DECIMAL(38,2)) AS total_gap,
        CAST(o.subtotal - coalesce(l.t, 0) AS DECIMAL(38,2)) AS lines_gap
      FROM m_orders o LEFT JOIN (SELECT order_id, sum(total_price) AS t FROM m_items GROUP BY 1) l USING (order_id))
    WHERE total_gap IS DISTINCT FROM 0 OR lines_gap IS DISTINCT FROM 0""",
)
def _(m: Model) -> DataFrame:
    return quality.order_arithmetic(m.orders, m.order_items)


@query(
    "q7_stock_reconciliation",
    """SELECT product_id, sku, system_stock, calculated_stock, system_stock - calculated_stock AS stock_gap
    FROM j_inventory WHERE system_stock <> calculated_stock""",
)
def _(m: Model) -> DataFrame:
    return quality.stock_mismatches(m.products, m.inventory_movements)


ROW_COUNT_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in TABLES)


@query("q8_row_count_report", ROW_COUNT_SQL)
def _(m: Model) -> DataFrame:
    return quality.row_counts(load_tables(m.spark, m.directory))


@query(
    "q9_cascade_delete",
    """SELECT i.order_id, i.product_id, i.quantity, i.total_price
    FROM m_items i JOIN m_orders o ON i.order_id = o.order_id JOIN m_customers c ON o.customer_id = c.customer_id
    WHERE c.customer_status = 'active'""",
)
def _(m: Model) -> DataFrame:
    """Lines that remain after customers who are not active are deleted with all they own."""
    kept = m.customers.where(F.col("customer_status") == "active")
    orders = cascade_delete(m.orders, "customer_id", kept, "customer_id")
    lines = cascade_delete(m.order_items, "order_id", orders, "order_id")
    return lines.select("order_id", "product_id", "quantity", "total_price")


@query(
    "q9_set_null",
    """SELECT category_id, category_name, CASE WHEN parent_category_id <> 'PROMO' THEN parent_category_id END
      AS parent_category_id FROM m_categories WHERE category_id <> 'PROMO'""",
)
def _(m: Model) -> DataFrame:
    kept = m.categories.where("is_active")
    return set_null_on_delete(kept, "parent_category_id", kept, "category_id").select(
        "category_id", "category_name", "parent_category_id"
    )


# ---- audit ----------------------------------------------------------------------------------


def _member(document: str, name: str, kind: str = "bigint"):
    return F.get_json_object(document, f"$.{name}").cast(kind)


@query(
    "a1_capture_changes",
    f"""SELECT *, 'customer_activity' AS table_name, 'etl_system' AS changed_by, 'ETL_Pipeline' AS application_name,
      'unknown' AS ip_address FROM ({CHANGES_SQL})""",
)
def _(m: Model) -> DataFrame:
    return captured(m).select(
        "operation",
        "record_id",
        _member("old_values", "orders").alias("old_orders"),
        _member("new_values", "orders").alias("new_orders"),
        _member("old_values", "spent", TOTAL).alias("old_spent"),
        _member("new_values", "spent", TOTAL).alias("new_spent"),
        _member("new_values", "frequent", "string").alias("frequent"),
        "table_name",
        "changed_by",
        "application_name",
        "ip_address",
    )


@query(
    "a2_apply_audit_config",
    """SELECT a.id, a.table_name, a.operation,
      CASE WHEN a.operation <> 'INSERT' THEN a.k END AS old_k,
      CASE WHEN a.operation <> 'DELETE' THEN a.new_k END AS new_k,
      CASE WHEN a.operation <> 'DELETE' AND NOT coalesce(c.hides_value, false) THEN a.value END AS new_value
    FROM m_audit a LEFT JOIN v_config c ON a.table_name = c.table_name
    WHERE c.table_name IS NULL OR (c.is_enabled AND CASE a.operation WHEN 'INSERT' THEN c.audit_inserts
      WHEN 'UPDATE' THEN c.audit_updates ELSE c.audit_deletes END)""",
)
def _(m: Model) -> DataFrame:
    return audit.apply_audit_config(m.audit_log, audit_config(m)).select(
        "id",
        "table_name",
        "operation",
        _member("old_values", "k").alias("old_k"),
        _member("new_values", "k").alias("new_k"),
        _member("new_values", "value", MONEY).alias("new_value"),
    )


@query(
    "a3_audit_trail",
    f"""SELECT id, table_name, operation, record_id, changed_by, changed_at, session_id, application_name, ip_address,
      CASE WHEN operation = 'DELETE' THEN k ELSE new_k END AS k,
      CASE WHEN operation <> 'DELETE' THEN value END AS value,
      CASE WHEN operation <> 'DELETE' THEN event_type END AS event_type
    FROM m_audit WHERE changed_at >= {THEN} - INTERVAL 90 DAY""",
)
def _(m: Model) -> DataFrame:
    trail = audit.audit_trail(m.audit_log, EVENTS_AS_OF, R)
    return trail.withColumns(
        {
            "k": _member("record_data", "k"),
            "value": _member("record_data", "value", MONEY),
            "event_type": _member("record_data", "event_type", "string"),
        }
    ).drop("record_data")


@query(
    "a4_apply_retention",
    f"""SELECT a.id, a.table_name, a.operation, a.changed_at FROM m_audit a
      LEFT JOIN v_config c ON a.table_name = c.table_name
    WHERE a.changed_at >= {THEN} - to_days(coalesce(c.retention_days, 2555))""",
)
def _(m: Model) -> DataFrame:
    kept = audit.apply_retention(m.audit_log, audit_config(m), EVENTS_AS_OF, R)
    return kept.select("id", "table_name", "operation", "changed_at")


@query(
    "a4_stored_retention",
    f"""SELECT a.id, a.table_name, a.operation, a.changed_at FROM m_audit a
      LEFT JOIN v_config c ON a.table_name = c.table_name
    WHERE a.changed_at >= {THEN} - to_days(coalesce(c.retention_days, 2555))""",
)
def _(m: Model) -> DataFrame:
    """The log as stored by table and month, after its expired rows were removed."""
    path, log = shared_dir(m.spark, "audit-log"), m.audit_log
    retention.save_log(log, path)
    retention.expire(m.spark, path, log.schema, audit_config(m), EVENTS_AS_OF, R)
    return retention.stored_log(m.spark, path, log.schema).select("id", "table_name", "operation", "changed_at")


GROWTH_SQL = f"""SELECT count(*) AS total_audit_records,
      count(*) FILTER (changed_at >= {THEN} - INTERVAL 1 HOUR) AS last_hour_records,
      count(*) FILTER (changed_at >= {THEN} - INTERVAL 1 DAY) AS last_day_records,
      min(changed_at) AS oldest_record, max(changed_at) AS newest_record FROM m_audit"""


@query("a5_audit_growth", GROWTH_SQL)
def _(m: Model) -> DataFrame:
    return audit.audit_growth(m.audit_log, EVENTS_AS_OF)


_PIVOT = ", ".join(f"count(*) FILTER (operation = '{o}') AS {o.lower()}s" for o in audit.OPERATIONS)


@query(
    "a6_audit_activity",
    f"""SELECT table_name, count(*) AS audit_records, {_PIVOT} FROM m_audit
    WHERE changed_at >= {THEN} - INTERVAL 1 DAY GROUP BY table_name ORDER BY audit_records DESC, table_name LIMIT 10""",
)
def _(m: Model) -> DataFrame:
    return audit.audit_activity(m.audit_log, EVENTS_AS_OF)


@query(
    "a7_daily_change_volume",
    f"""SELECT CAST(changed_at AS DATE) AS audit_date, count(*) AS total_operations,
      count(*) FILTER (operation = 'SELECT') AS selects, {_PIVOT} FROM m_audit
    WHERE changed_at >= {THEN} - INTERVAL 7 DAY GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return audit.daily_change_volume(m.audit_log, EVENTS_AS_OF)


@query(
    "a8_session_context",
    """SELECT order_id, order_status, 'etl_system' AS changed_by, 'etl_20010802' AS session_id,
      'Spark-Direct' AS application_name, 'unknown' AS ip_address, CAST(NULL AS VARCHAR) AS user_agent FROM m_orders""",
)
def _(m: Model) -> DataFrame:
    context = audit.stamped({"user": "etl_system", "session_id": "etl_20010802"})
    return m.orders.select("order_id", "order_status").withColumns(context)


# ---- logs and table health ------------------------------------------------------------------


@query(
    "n1_slowest_events",
    f"""SELECT event_id, logged_at, user_id, duration, rows_examined, pattern, substring(text, 1, 200) AS text_preview
    FROM m_log WHERE logged_at >= {THEN} - INTERVAL 1 HOUR ORDER BY duration DESC, event_id LIMIT 20""",
)
def _(m: Model) -> DataFrame:
    return monitoring.slowest_events(m.log, EVENTS_AS_OF)


@query(
    "n2_pattern_digest",
    f"""SELECT * FROM (SELECT pattern, count(*) AS exec_count,
        {sql_mean("sum(duration)", "count(duration)")} AS avg_exec_time, max(duration) AS max_exec_time,
        {sql_mean("sum(rows_examined)", "count(*)")} AS avg_rows_examined,
        min(logged_at) AS first_seen, max(logged_at) AS last_seen FROM m_log GROUP BY pattern)
    WHERE avg_exec_time > 49.0 ORDER BY avg_exec_time DESC, pattern LIMIT 10""",
)
def _(m: Model) -> DataFrame:
    return monitoring.pattern_digest(m.log, 49.0)


@query(
    "n2_heavy_users",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM m_log GROUP BY 1
    ORDER BY n DESC, user_id NULLS FIRST LIMIT 25""",
)
def _(m: Model) -> DataFrame:
    """The users with most entries, from summaries of the tasks and a second pass over their candidates."""
    return heavy_hitters(m.log, "user_id", 25)


QUALITY_SQL = f"""SELECT total_queries, slow_queries, errors,
      {sql_mean("d", "total_queries")} AS average_execution_time,
      {sql_rate("errors", "total_queries")} AS error_rate,
      {sql_rate("slow_queries", "total_queries")} AS slow_query_rate
    FROM (SELECT count(*) AS total_queries, count(*) FILTER (duration > {SLOW}) AS slow_queries,
      count(*) FILTER (is_error) AS errors, sum(duration) AS d FROM m_log)"""


@query("n3_log_quality", QUALITY_SQL)
def _(m: Model) -> DataFrame:
    return monitoring.log_quality(m.log, SLOW)


@query(
    "n4_usage_by_user",
    f"""SELECT user_id, count(*) AS connection_count, count(*) FILTER (pattern <> 'view') AS active_connections,
      {sql_mean("sum(duration)", "count(duration)")} AS avg_time, max(duration) AS max_time
    FROM m_log GROUP BY user_id""",
)
def _(m: Model) -> DataFrame:
    return monitoring.usage_by_user(m.log, "view")


# the test tables have no such amounts, so the model fills them with zeros
_ZERO = dict.fromkeys(("tax_amount", "shipping_amount", "discount_amount"), "0")
_PROFILED = {
    t: [f.split()[0] for f in columns.split(", ")]
    for t, columns in (("orders", schemas.ORDERS), ("order_items", schemas.ORDER_ITEMS))
}


@query(
    "n5_column_selectivity",
    "SELECT *, CASE WHEN cardinality = 0 THEN 'No selectivity' WHEN cardinality < 10 THEN 'Low selectivity' "
    "WHEN cardinality < 100 THEN 'Medium selectivity' ELSE 'High selectivity' END AS selectivity_level FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {_ZERO.get(c, c)}) AS cardinality "
        f"FROM {SQL_NAME[t]}"
        for t, columns in _PROFILED.items()
        for c in columns
    )
    + ")",
)
def _(m: Model) -> DataFrame:
    return quality.stacked(
        [monitoring.column_selectivity(t, getattr(m, t), columns, exact=True) for t, columns in _PROFILED.items()]
    )


@query(
    "n5_selectivity_sketched",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {SQL_NAME[t]}) AS total_rows, "
        "true AS distinct_in_bound"
        for t, columns in _PROFILED.items()
        for c in columns
    ),
)
def _(m: Model) -> DataFrame:
    """Distinct values per column from the stored sketches of every load, held against the exact counts."""
    loads = {"orders": year_month("created_at"), "order_items": F.floor(F.col("order_id") / 100_000)}
    found = []
    for t, columns in _PROFILED.items():
        df = getattr(m, t)
        stored = written(sketches.distinct_sketches(df, [loads[t].alias("load")], columns), "distinct-sketches")
        estimates = sketches.merged_selectivity(stored)
        exact = monitoring.column_selectivity(t, df, columns, exact=True)
        off = F.abs(F.col("distinct_values") - F.col("cardinality"))
        inside = off <= 5 * sketches.DISTINCT_ERROR * F.col("cardinality")
        joined = exact.join(estimates, "column_name")
        found.append(joined.select("table_name", "column_name", "total_rows", inside.alias("distinct_in_bound")))
    return quality.stacked(found)


@query(
    "n6_never_used",
    """SELECT order_id, customer_id, total_amount FROM m_orders
    WHERE order_id NOT IN (SELECT order_id FROM m_items)""",
)
def _(m: Model) -> DataFrame:
    return never_used(m.orders, m.order_items, "order_id").select("order_id", "customer_id", "total_amount")


@query("n7_table_sizes", ROW_COUNT_SQL.replace("record_count", "table_rows"))
def _(m: Model) -> DataFrame:
    """Rows per table; the byte figures depend on the files and are tested separately."""
    return monitoring.table_sizes(load_tables(m.spark, m.directory)).select("table_name", "table_rows")


@query(
    "n8_freshness",
    f"""SELECT count(*) AS total_summaries, min(last_calculated_at) AS oldest_calculation,
      max(last_calculated_at) AS newest_calculation,
      count(*) FILTER (last_calculated_at < TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 1 DAY) AS stale_summaries
    FROM ({BACKFILL_SQL})""",
)
def _(m: Model) -> DataFrame:
    return monitoring.freshness(backfilled(m), "2001-08-02 00:00:00")


@query(
    "n9_health_rollup",
    f"""WITH checks AS (
      SELECT 'query_performance' AS component, CASE WHEN slow_query_rate > 25 THEN 'critical'
        WHEN slow_query_rate > 10 THEN 'warning' WHEN error_rate > 5 THEN 'critical'
        WHEN error_rate > 1 THEN 'warning' ELSE 'healthy' END AS status, total_queries AS test_result
      FROM ({QUALITY_SQL})
      UNION ALL SELECT 'audit_log', CASE WHEN last_hour_records = 0 THEN 'warning' ELSE 'healthy' END,
        last_hour_records FROM ({GROWTH_SQL})
      UNION ALL SELECT 'summary_freshness', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'healthy' END, count(*)
      FROM j_summary WHERE last_calculated_at < {THEN} - INTERVAL 1 DAY
      UNION ALL SELECT 'slow_patterns', CASE WHEN count(*) < 10 THEN 'healthy' ELSE 'warning' END, count(*)
      FROM (SELECT pattern FROM m_log GROUP BY pattern
        HAVING CAST(sum(duration) AS DOUBLE) / CAST(count(duration) AS DOUBLE) > 49.0)
      UNION ALL SELECT 'database', CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'critical' END, count(*) FROM m_items)
    SELECT * FROM checks
    UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'critical') THEN 'critical'
      WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END,
      count(*) FILTER (status <> 'healthy') FROM checks""",
)
def _(m: Model) -> DataFrame:
    checks = monitoring.health_checks(
        monitoring.log_quality(m.log, SLOW),
        audit.audit_growth(m.audit_log, EVENTS_AS_OF),
        # the summary was calculated years before the events, so all of it is stale
        monitoring.freshness(summary(m), EVENTS_AS_OF),
        quality.row_counts({"order_items": m.order_items}),
        slow_patterns=monitoring.slow_patterns(m.log, 49.0),
    )
    return monitoring.health_rollup(checks)


