"""The analytical jobs (K) and the procedural surface (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.catalog.model_sql import NOW, R, segment_sql
from merchantry.catalog.registry import AS_OF, CTES, query, sql_mean, sql_percent
from merchantry.catalog.sources import RECENT_DAYS
from merchantry.functions.classify import customer_segment, lifetime_value_tier
from merchantry.functions.scalar import TOTAL, age_years, month_index
from merchantry.plans import activity, audit, cohorts, customers, differences, maintained, products, refresh, sales
from merchantry.sources.adapter import Model
from merchantry.sources.shared import shared_dir, written
from merchantry.sources.sinks import load


def summary(m: Model) -> DataFrame:
    return customers.customer_order_summary(m.customers, m.orders, m.order_items, AS_OF, R)


def daily(m: Model) -> DataFrame:
    return sales.daily_sales_summary(m.orders, m.customers, AS_OF)


def performance(m: Model) -> DataFrame:
    return products.product_performance(m.products, m.order_items, m.orders, m.categories, AS_OF, R)


def inventory(m: Model) -> DataFrame:
    return products.product_inventory(m.products, m.inventory_movements)


def cohort_table(m: Model) -> DataFrame:
    return cohorts.customer_cohorts(m.orders, AS_OF)


query("k1_customer_order_summary", "SELECT * FROM j_summary")(summary)


@query("k1b_customer_order_summary_line_grain", "SELECT * FROM j_line_summary")
def _(m: Model) -> DataFrame:
    return customers.customer_order_summary_line_grain(m.customers, m.orders, m.order_items, AS_OF, R)


@query("k1c_recent_customer_summary", "SELECT * FROM j_recent")
def _(m: Model) -> DataFrame:
    return customers.recent_customer_summary(m.customers, m.orders, AS_OF, R, RECENT_DAYS)


@query("k2_customer_segment", "SELECT customer_id, customer_segment FROM j_summary")
def _(m: Model) -> DataFrame:
    return summary(m).select("customer_id", customer_segment(R).alias("customer_segment"))


@query("k3_lifetime_value_tier", "SELECT customer_id, total_spent, lifetime_value_tier FROM j_summary")
def _(m: Model) -> DataFrame:
    return summary(m).select("customer_id", "total_spent", lifetime_value_tier(R).alias("lifetime_value_tier"))


CTES["v_place"] = """
  SELECT customer_id, city AS primary_shipping_city, state AS primary_shipping_state,
    country AS primary_shipping_country, n AS orders_to_place
  FROM (SELECT o.customer_id, a.city, a.state, a.country, count(*) AS n,
      row_number() OVER (PARTITION BY o.customer_id ORDER BY count(*) DESC, a.city, a.state, a.country) AS r
    FROM m_live o JOIN m_addresses a ON o.shipping_address_id = a.address_id
    GROUP BY o.customer_id, a.city, a.state, a.country) WHERE r = 1"""
CTES["v_category"] = """
  SELECT s.customer_id, g.category_name AS favorite_category,
    row_number() OVER (PARTITION BY s.customer_id ORDER BY sum(s.quantity) DESC, g.category_name) AS r
  FROM j_sold s JOIN m_products p ON s.product_id = p.product_id
    JOIN m_categories g ON p.category_id = g.category_id
  GROUP BY s.customer_id, g.category_name"""
CTES["v_behaviour"] = """
  SELECT s.customer_id, c.favorite_category, CAST(sum(s.quantity) AS BIGINT) AS total_products_purchased,
    count(DISTINCT s.product_id) AS unique_products_purchased
  FROM j_sold s JOIN v_category c ON s.customer_id = c.customer_id AND c.r = 1
  GROUP BY s.customer_id, c.favorite_category"""


def geography(m: Model) -> DataFrame:
    return customers.customer_geography(m.orders, m.addresses)


def behaviour(m: Model) -> DataFrame:
    return customers.customer_behaviour(m.orders, m.order_items, m.products, m.categories)


query("k4_customer_geography", "SELECT * FROM v_place")(geography)
query("k5_customer_behaviour", "SELECT * FROM v_behaviour")(behaviour)


@query(
    "k5_customer_report",
    """SELECT s.*, p.primary_shipping_city, p.primary_shipping_state, p.primary_shipping_country, b.favorite_category,
      coalesce(b.unique_products_purchased, 0) AS unique_products_purchased
    FROM j_summary s LEFT JOIN v_place p ON s.customer_id = p.customer_id
      LEFT JOIN v_behaviour b ON s.customer_id = b.customer_id""",
)
def _(m: Model) -> DataFrame:
    """The full summary row: order figures, segment and tier with place and behaviour."""
    return customers.customer_report(summary(m), geography(m), behaviour(m))


SEGMENT_SQL = f"""SELECT customer_segment, count(*) AS customer_count,
      {sql_percent("count(*)", "(SELECT count(*) FROM j_summary)")} AS percentage,
      {sql_mean("sum(total_spent)", "count(*)")} AS avg_total_spent,
      {sql_mean("sum(total_orders)", "count(*)")} AS avg_total_orders,
      {sql_mean("sum(days_since_last_order)", "count(days_since_last_order)")} AS avg_days_since_last_order
    FROM j_summary GROUP BY customer_segment"""


@query("k6_customer_segment_distribution", SEGMENT_SQL)
def _(m: Model) -> DataFrame:
    return customers.customer_segment_distribution(summary(m))


query("k7_daily_sales_summary", "SELECT * FROM j_daily")(daily)


@query("k8_daily_sales_report", "SELECT * FROM j_report")
def _(m: Model) -> DataFrame:
    days = m.orders.select(F.to_date("created_at").alias("holiday")).distinct()
    christmas = days.where((F.month("holiday") == 12) & (F.dayofmonth("holiday") == 25))
    return sales.daily_sales_report(
        m.orders,
        m.customers,
        m.order_items,
        m.products,
        m.categories,
        m.addresses,
        m.shipments,
        AS_OF,
        holidays=christmas,
    )


EARLIER = "2001-07-28 00:00:00"


def _stale_daily(m: Model) -> DataFrame:
    """The daily table as it stood some days ago: the last days are missing."""
    seen = m.orders.where(F.col("created_at") < F.lit(EARLIER).cast("timestamp_ntz"))
    return sales.daily_sales_summary(seen, m.customers, EARLIER)


BACKFILL_SQL = f"""SELECT * REPLACE (
      CASE WHEN summary_date >= CAST({NOW} - INTERVAL 7 DAY AS DATE) THEN {NOW} ELSE TIMESTAMP '{EARLIER}' END
        AS last_calculated_at) FROM j_daily WHERE summary_date < CAST({NOW} AS DATE)"""


def backfilled(m: Model) -> DataFrame:
    return sales.backfill_daily(_stale_daily(m), m.orders, m.customers, AS_OF, R)


query("k9_backfill_daily", BACKFILL_SQL)(backfilled)


@query("k9_backfill_daily_table", BACKFILL_SQL)
def _(m: Model) -> DataFrame:
    """The same backfill into a table partitioned by year, touching the affected years only."""
    out = shared_dir(m.spark, "backfill")
    load(refresh.by_year(_stale_daily(m)), out, "replace", [refresh.YEAR])
    refresh.upsert_daily_sales(m.spark, out, m.customers, m.orders, AS_OF, R)
    return m.spark.read.parquet(out).drop(refresh.YEAR)


@query(
    "k10_monthly_sales_trend",
    f"""SELECT strftime(summary_date, '%Y-%m') AS month, CAST(sum(total_orders) AS BIGINT) AS monthly_orders,
      CAST(sum(total_order_value) AS DECIMAL(38,2)) AS monthly_revenue,
      {sql_mean("sum(avg_order_value)", "count(avg_order_value)")} AS avg_monthly_order_value,
      CAST(sum(new_customers) AS BIGINT) AS new_customers_acquired,
      {sql_mean("sum(total_customers)", "count(total_customers)")} AS avg_daily_customers
    FROM j_daily WHERE summary_date >= CAST({NOW} - INTERVAL 24 MONTH AS DATE) GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return sales.monthly_sales_trend(daily(m), AS_OF, R)


query("k11_product_performance", "SELECT * FROM j_perf")(performance)


@query("k12_performance_tier", "SELECT product_id, total_revenue, performance_tier FROM j_perf")
def _(m: Model) -> DataFrame:
    return performance(m).select("product_id", "total_revenue", "performance_tier")


@query("k13_velocity_category", "SELECT product_id, total_quantity_sold, velocity_category FROM j_perf")
def _(m: Model) -> DataFrame:
    return performance(m).select("product_id", "total_quantity_sold", "velocity_category")


@query(
    "k14_top_performing_products",
    """SELECT product_id, sku, product_name, category_name, total_quantity_sold, total_revenue, total_profit,
      profit_margin_percent, performance_tier, velocity_category, unique_customers,
      rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank,
      rank() OVER (ORDER BY total_quantity_sold DESC) AS quantity_rank
    FROM j_perf WHERE is_active""",
)
def _(m: Model) -> DataFrame:
    return products.top_performing_products(performance(m))


query("k15_customer_cohorts", "SELECT * FROM j_cohorts")(cohort_table)
query("k16_product_inventory", "SELECT * FROM j_inventory")(inventory)


@query(
    "k16_product_inventory_strict",
    """SELECT * REPLACE (CASE WHEN calculated_stock <= 0 THEN 'out_of_stock'
      WHEN calculated_stock <= reorder_level THEN 'reorder' ELSE 'in_stock' END AS stock_status) FROM j_inventory""",
)
def _(m: Model) -> DataFrame:
    return products.product_inventory(m.products, m.inventory_movements, strict=True)


@query("k17_category_paths", "SELECT * FROM j_paths")
def _(m: Model) -> DataFrame:
    return products.category_paths(m.categories)


@query(
    "k18_customer_clean",
    f"""SELECT customer_id, lower(email) AS email, first_name || ' ' || last_name AS customer_name,
      CAST(floor(date_diff('day', date_of_birth, CAST({NOW} AS DATE)) / 365.0) AS BIGINT) AS age,
      {NOW} AS processed_at, 'etl_20010802' AS etl_batch_id
    FROM m_customers WHERE email IS NOT NULL""",
)
def _(m: Model) -> DataFrame:
    clean = customers.customer_clean(m.customers, AS_OF, "etl_20010802")
    return clean.select("customer_id", "email", "customer_name", "age", "processed_at", "etl_batch_id")


@query(
    "k19_customer_spend_report",
    """SELECT c.first_name, c.last_name, c.email, count(o.order_id) AS total_orders,
      CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2)) AS total_spent
    FROM m_customers c LEFT JOIN m_orders o ON c.customer_id = o.customer_id
    GROUP BY c.customer_id, c.first_name, c.last_name, c.email""",
)
def _(m: Model) -> DataFrame:
    return customers.customer_spend_report(m.customers, m.orders)


@query("k20_top_customers_by_segment", "SELECT * FROM j_summary WHERE customer_segment = 'vip'")
def _(m: Model) -> DataFrame:
    return customers.top_customers_by_segment(summary(m), "vip")


@query("k21_low_stock", "SELECT * FROM j_inventory WHERE stock_status IN ('reorder', 'out_of_stock')")
def _(m: Model) -> DataFrame:
    return products.low_stock(inventory(m))


@query("k22_cohorts_since", "SELECT * FROM j_cohorts WHERE cohort_month >= DATE '1997-01-01'")
def _(m: Model) -> DataFrame:
    return cohorts.cohorts_since(cohort_table(m), "1997-01-01")


# ---- procedural surface -------------------------------------------------------------------


@query(
    "x1_segment_classifier",
    f"""SELECT customer_id, {segment_sql("total_orders", "days_since_last_order", "total_spent")} AS customer_segment
    FROM j_recent""",
)
def _(m: Model) -> DataFrame:
    recent = customers.recent_customer_summary(m.customers, m.orders, AS_OF, R, RECENT_DAYS)
    return recent.select("customer_id", "customer_segment")


@query(
    "x2_customer_age",
    f"""SELECT customer_id, CAST(floor(date_diff('day', date_of_birth, CAST({NOW} AS DATE)) / 365.0) AS BIGINT) AS age
    FROM m_customers""",
)
def _(m: Model) -> DataFrame:
    return m.customers.select("customer_id", age_years("date_of_birth", AS_OF).alias("age"))


@query("x3_refresh_customer_order_summary", "SELECT * FROM j_summary")
def _(m: Model) -> DataFrame:
    out = shared_dir(m.spark, "summary")
    refresh.rebuild_customer_summary(out, m.customers, m.orders, m.order_items, AS_OF, R)
    return m.spark.read.parquet(out)


def totals_before(m: Model, as_of: str) -> DataFrame:
    """Customers with their orders so far, as a table that changes over time."""
    seen = m.orders.where(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz"))
    return seen.groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        F.sum("total_amount").cast(TOTAL).alias("spent"),
        F.max("created_at").alias("last_order"),
    )


EARLIER_SNAPSHOT = "2001-07-01 00:00:00"


def _snapshot_sql(as_of: str) -> str:
    return f"""SELECT customer_id, count(*) AS orders, CAST(sum(total_amount) AS DECIMAL(38,2)) AS spent,
      max(created_at) AS last_order FROM m_orders WHERE created_at < TIMESTAMP '{as_of}' GROUP BY 1"""


# customers who are no longer active leave the table, and the later one has a column more
CHANGES_SQL = f"""SELECT
      CASE WHEN o.customer_id IS NULL THEN 'INSERT' WHEN n.customer_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END
        AS operation, CAST(coalesce(o.customer_id, n.customer_id) AS VARCHAR) AS record_id,
      o.orders AS old_orders, n.orders AS new_orders, o.spent AS old_spent, n.spent AS new_spent, n.frequent AS frequent
    FROM ({_snapshot_sql(EARLIER_SNAPSHOT)}) o
    FULL OUTER JOIN (SELECT s.*, CASE WHEN s.orders > 10 THEN 'yes' END AS frequent FROM ({_snapshot_sql(AS_OF)}) s
      JOIN m_customers c ON s.customer_id = c.customer_id WHERE c.customer_status = 'active') n
      ON o.customer_id = n.customer_id
    WHERE (o.orders, o.spent) IS DISTINCT FROM (n.orders, n.spent) OR n.frequent IS NOT NULL"""


def earlier_facts(m: Model, facts: DataFrame) -> DataFrame:
    """The order facts as of EARLIER_SNAPSHOT: later orders are missing, those cancelled by now are
    still pending, delivered ones cost more, and each refunded one has a twin that was deleted since."""
    seen = facts.where(F.col("created_at") < F.lit(EARLIER_SNAPSHOT).cast("timestamp_ntz"))
    status = F.when(F.col("order_status") == "cancelled", "pending").otherwise(F.col("order_status"))
    price = F.when(F.col("order_status") == "delivered", F.col("total_amount") + 250).otherwise(F.col("total_amount"))
    earlier = seen.withColumns({"order_status": status, "total_amount": price.cast("decimal(18,2)")})
    twins = seen.where(F.col("order_status").isin("cancelled", "refunded")).withColumns(
        {
            "order_id": -F.col("order_id"),
            "order_status": F.lit("pending"),
            "created_at": F.expr("created_at - interval 3 years"),
        }
    )
    return earlier.unionByName(twins)


@query("x3_maintained_customer_summary", "SELECT * FROM j_summary")
def _(m: Model) -> DataFrame:
    facts = maintained.order_facts(m.orders, m.order_items)
    before = earlier_facts(m, facts)
    log = audit.capture_changes(before, facts, "order_id", "orders", AS_OF)
    changes = maintained.logged_orders(log, "orders")
    figures = maintained.updated_figures(maintained.first_figures(before), changes, facts)
    return maintained.maintained_summary(m.customers, figures, AS_OF, R)


def captured(m: Model) -> DataFrame:
    active = m.customers.where(F.col("customer_status") == "active").select("customer_id")
    old = totals_before(m, EARLIER_SNAPSHOT)
    new = totals_before(m, AS_OF).join(active, "customer_id", "left_semi")
    new = new.withColumn("frequent", F.when(F.col("orders") > 10, "yes"))
    context = {"user": "etl_system", "application": "ETL_Pipeline"}
    return audit.capture_changes(
        old, new, "customer_id", "customer_activity", AS_OF, context, exclude=["last_order"]
    )


@query("x4_change_operations", f"SELECT operation, count(*) AS changes FROM ({CHANGES_SQL}) GROUP BY operation")
def _(m: Model) -> DataFrame:
    return captured(m).groupBy("operation").agg(F.count("*").alias("changes"))


@query("x4_stored_changes", f"SELECT operation, count(*) AS changes FROM ({CHANGES_SQL}) GROUP BY operation")
def _(m: Model) -> DataFrame:
    """The same changes from two stored snapshots, whose parts with equal digests are not read."""
    active = m.customers.where(F.col("customer_status") == "active").select("customer_id")
    old = totals_before(m, EARLIER_SNAPSHOT).withColumn("frequent", F.lit(None).cast("string"))
    new = totals_before(m, AS_OF).join(active, "customer_id", "left_semi")
    new = new.withColumn("frequent", F.when(F.col("orders") > 10, "yes"))
    paths = [shared_dir(m.spark, f"totals-{side}") for side in ("old", "new")]
    for df, path in zip((old, new), paths, strict=True):
        differences.save_in_parts(df, "customer_id", path, 64)
    changes = differences.stored_changes(m.spark, *paths, "customer_id", "customer_activity", AS_OF, exclude=["last_order"])
    return changes.groupBy("operation").agg(F.count("*").alias("changes"))


_LAGS = (1, 3, 12)


@query(
    "k15_active_customers",
    f"""WITH bought AS (SELECT DISTINCT customer_id, year(created_at) * 12 + month(created_at) - 1 AS month_index
        FROM m_orders WHERE order_status <> 'cancelled' AND customer_id IS NOT NULL),
      born AS (SELECT customer_id, min(month_index) AS first_month FROM bought GROUP BY 1)
    SELECT b.month_index, count(*) AS active, count(*) FILTER (b.month_index = f.first_month) AS newly_active,
      {", ".join(f"count(r{n}.customer_id) AS retained_{n}" for n in _LAGS)}
    FROM bought b JOIN born f ON b.customer_id = f.customer_id
      {" ".join(f"LEFT JOIN bought r{n} ON r{n}.customer_id = b.customer_id AND r{n}.month_index = b.month_index - {n}" for n in _LAGS)}
    GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    """Monthly buyers, new and retained ones, all from the stored bitmaps of days."""
    live = customers.not_cancelled(m.orders)
    days = activity.id_bitmaps(live, [F.to_date("created_at").alias("day")], "customer_id")
    stored = written(days, "id-bitmaps")
    months = written(activity.united(stored, [month_index("day").alias("month_index")]), "id-bitmaps")
    return activity.activity_by_period(months, "month_index", _LAGS)
