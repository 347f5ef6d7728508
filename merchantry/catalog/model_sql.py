"""SQL definitions of the model tables and of the summaries that several oracles build on."""

from __future__ import annotations

from merchantry.catalog.registry import (
    AS_OF,
    CTES,
    sql_mean_money,
    sql_month,
    sql_percent,
)
from merchantry.rules import Rules

R = Rules.testdata()
NOW = f"TIMESTAMP '{AS_OF}'"

CTES["m_customers"] = """
  SELECT c_custkey AS customer_id, c_name || '@Example.com' AS email,
    split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
    '+1-555-' || split_part(c_name, '#', 2) AS phone,
    CAST(DATE '1960-01-01' + CAST(floor(c_acctbal) AS INTEGER) AS DATE) AS date_of_birth,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'inactive' WHEN 'FURNITURE' THEN 'suspended'
      ELSE 'active' END AS customer_status,
    f.created_at
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
    ON c_custkey = f.o_custkey"""

CTES["m_addresses"] = """
  SELECT c_custkey AS address_id, c_custkey AS customer_id, 'both' AS address_type, n_name AS city,
    r_name AS state, 'US' AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["m_categories"] = """
  SELECT *, lower(category_id) AS category_slug, category_id <> 'PROMO' AS is_active FROM (
    SELECT DISTINCT p_type AS category_id, CAST(NULL AS VARCHAR) AS parent_category_id,
      p_type AS category_name FROM part
    UNION ALL
    SELECT DISTINCT p_type || '/' || p_brand, p_type, p_type || ' ' || p_brand FROM part)"""

CTES["m_products"] = """
  SELECT p_partkey AS product_id, p_type || '/' || p_brand AS category_id,
    'SKU-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name,
    replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS product_slug,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price,
    CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.6 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS cost,
    p_size <> 1 AS is_active, CAST(p_size AS BIGINT) AS stock_quantity, CAST(10 AS BIGINT) AS reorder_level
  FROM part"""

CTES["m_orders"] = """
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_number,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'processing'
      WHEN o_orderpriority = '5-LOW' THEN 'cancelled'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'refunded' ELSE 'pending' END AS order_status,
    o_custkey AS billing_address_id, o_custkey AS shipping_address_id,
    CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
    CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'pending'
      WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'refunded' ELSE 'pending' END AS payment_status,
    o_orderpriority AS payment_method, o_orderdate AS created_at
  FROM orders"""

CTES["m_live"] = "SELECT * FROM m_orders WHERE order_status <> 'cancelled'"

CTES["m_items"] = f"""
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
    {sql_mean_money("l_extendedprice", "l_quantity")} AS unit_price,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price
  FROM lineitem"""

CTES["m_moves"] = """
  SELECT l_partkey AS product_id,
    CASE l_returnflag WHEN 'N' THEN 'out' WHEN 'R' THEN 'in' ELSE 'adjustment' END AS movement_type,
    CASE l_returnflag WHEN 'R' THEN CAST(l_quantity AS BIGINT) ELSE -CAST(l_quantity AS BIGINT) END AS quantity,
    CASE l_returnflag WHEN 'N' THEN 'sale' WHEN 'R' THEN 'return' ELSE 'adjustment' END AS reference_type,
    l_orderkey AS reference_id, l_shipdate AS movement_date
  FROM lineitem
  UNION ALL
  SELECT p_partkey, 'in', CAST(260 AS BIGINT), 'purchase', NULL, TIMESTAMP '1995-01-01' FROM part"""

CTES["m_log"] = """
  SELECT event_id, ts AS logged_at, user_id, event_type AS pattern,
    CAST(value AS DECIMAL(18,2)) AS duration,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows_examined,
    event_type = 'error' AS is_error, props AS text
  FROM events"""

CTES["m_audit"] = """
  SELECT event_id AS id,
    CASE WHEN k < 40 THEN 'orders' WHEN k < 70 THEN 'order_items' WHEN k < 85 THEN 'products'
      ELSE 'customers' END AS table_name,
    CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    CAST(user_id AS VARCHAR) AS record_id, event_type, k, CAST(value AS DECIMAL(18,2)) AS value,
    CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN k + 1000 ELSE k END AS new_k,
    'user_' || CAST(user_id AS VARCHAR) AS changed_by, ts AS changed_at, 'session_' || CAST(user_id AS VARCHAR) AS session_id,
    'events' AS application_name,
    'unknown' AS ip_address
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def segment_sql(orders: str, idle: str, spent: str) -> str:
    return f"""CASE WHEN {orders} = 0 THEN 'new' WHEN {idle} > {R.churned_after_days} THEN 'churned'
      WHEN {idle} > {R.at_risk_after_days} THEN 'at_risk'
      WHEN {spent} > {R.vip_above_spent} OR {orders} > {R.vip_above_orders} THEN 'vip'
      WHEN {orders} > {R.regular_above_orders} THEN 'regular' ELSE 'new' END"""


def tier_sql(spent: str) -> str:
    return f"""CASE WHEN {spent} >= {R.premium_from} THEN 'premium' WHEN {spent} >= {R.high_from} THEN 'high'
      WHEN {spent} >= {R.medium_from} THEN 'medium' ELSE 'low' END"""


def _summary_sql(item_join: str, units: str) -> str:
    grouped = f"""
    SELECT c.customer_id, c.email AS customer_email, c.first_name || ' ' || c.last_name AS customer_name,
      c.phone AS customer_phone, CAST(c.created_at AS DATE) AS customer_created_date,
      count(o.order_id) AS total_orders,
      CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2)) AS total_spent,
      coalesce({sql_mean_money("sum(o.total_amount)", "count(o.total_amount)")}, CAST(0 AS DECIMAL(18,2)))
        AS avg_order_value,
      CAST(coalesce(min(o.total_amount), 0) AS DECIMAL(18,2)) AS min_order_value,
      CAST(coalesce(max(o.total_amount), 0) AS DECIMAL(18,2)) AS max_order_value,
      min(o.created_at) AS first_order_date, max(o.created_at) AS last_order_date,
      CAST(date_diff('day', max(o.created_at), {NOW}) AS BIGINT) AS days_since_last_order,
      CAST(coalesce(sum({units}), 0) AS BIGINT) AS total_products_purchased,
      {NOW} AS last_calculated_at
    FROM m_customers c LEFT JOIN m_live o ON c.customer_id = o.customer_id {item_join}
    GROUP BY c.customer_id, c.email, c.first_name, c.last_name, c.phone, c.created_at"""
    return f"""
  SELECT *, {segment_sql("total_orders", "days_since_last_order", "total_spent")} AS customer_segment,
    {tier_sql("total_spent")} AS lifetime_value_tier
  FROM ({grouped})"""


CTES["j_units"] = "SELECT order_id, CAST(sum(quantity) AS BIGINT) AS units FROM m_items GROUP BY order_id"
CTES["j_summary"] = _summary_sql("LEFT JOIN j_units u ON o.order_id = u.order_id", "u.units")
CTES["j_line_summary"] = _summary_sql("LEFT JOIN m_items i ON o.order_id = i.order_id", "i.quantity")

CTES["j_daily"] = f"""
  SELECT *, total_customers - new_customers AS returning_customers, dayname(summary_date) AS day_of_week,
    dayofweek(summary_date) IN (0, 6) AS is_weekend, {NOW} AS last_calculated_at
  FROM (
    SELECT CAST(o.created_at AS DATE) AS summary_date, count(DISTINCT o.order_id) AS total_orders,
      CAST(sum(o.total_amount) AS DECIMAL(38,2)) AS total_order_value,
      {sql_mean_money("sum(o.total_amount)", "count(o.total_amount)")} AS avg_order_value,
      count(DISTINCT o.customer_id) AS total_customers,
      count(DISTINCT CASE WHEN c.created_at >= CAST(o.created_at AS DATE) - INTERVAL 1 DAY
        THEN o.customer_id END) AS new_customers
    FROM m_live o JOIN m_customers c ON o.customer_id = c.customer_id
    GROUP BY CAST(o.created_at AS DATE))"""

CTES["j_paths"] = """
  SELECT category_id, category_name, category_name AS category_hierarchy, CAST(1 AS BIGINT) AS depth
  FROM m_categories WHERE parent_category_id IS NULL
  UNION ALL
  SELECT c.category_id, c.category_name, p.category_hierarchy || ' > ' || c.category_name, p.depth + 1
  FROM m_categories c JOIN j_paths p ON c.parent_category_id = p.category_id"""

CTES["j_sold"] = """
  SELECT i.order_id, i.product_id, o.customer_id, o.created_at, i.quantity, i.total_price
  FROM m_items i JOIN m_live o ON i.order_id = o.order_id"""

_SPEED = (
    "CAST(total_quantity_sold AS DOUBLE) / CAST("
    + sql_month("last_sale_date")
    + " - "
    + sql_month("first_sale_date")
    + " - CASE WHEN day(last_sale_date) < day(first_sale_date) THEN 1 ELSE 0 END + 1 AS DOUBLE)"
)

CTES["j_perf"] = f"""
  SELECT *, CAST(total_revenue - total_cost AS DECIMAL(38,2)) AS total_profit,
    {sql_percent("(total_revenue - total_cost)", "total_revenue")} AS profit_margin_percent,
    {sql_mean_money("total_quantity_sold", "total_orders")} AS avg_quantity_per_order,
    {sql_mean_money("total_revenue", "total_orders")} AS avg_revenue_per_order,
    CASE WHEN total_revenue >= {R.top_revenue_from} THEN 'top' WHEN total_revenue >= {R.high_revenue_from} THEN 'high'
      WHEN total_revenue >= {R.medium_revenue_from} THEN 'medium' ELSE 'low' END AS performance_tier,
    CASE WHEN {_SPEED} >= {R.very_fast_from} THEN 'very_fast' WHEN {_SPEED} >= {R.fast_from} THEN 'fast'
      WHEN {_SPEED} >= {R.normal_from} THEN 'normal' ELSE 'slow' END AS velocity_category,
    CAST(first_sale_date AS DATE) AS summary_period_start, CAST({NOW} AS DATE) AS summary_period_end,
    {NOW} AS last_calculated_at
  FROM (
    SELECT p.product_id, p.sku, p.product_name, c.category_name, c.category_hierarchy,
      CAST(coalesce(sum(s.quantity), 0) AS BIGINT) AS total_quantity_sold,
      CAST(coalesce(sum(s.total_price), 0) AS DECIMAL(38,2)) AS total_revenue,
      CAST(coalesce(sum(s.quantity), 0) * p.cost AS DECIMAL(38,2)) AS total_cost,
      count(DISTINCT s.order_id) AS total_orders, count(DISTINCT s.customer_id) AS unique_customers,
      min(s.created_at) AS first_sale_date, max(s.created_at) AS last_sale_date,
      CAST(date_diff('day', max(s.created_at), {NOW}) AS BIGINT) AS days_since_last_sale,
      p.price AS current_price, p.stock_quantity AS current_stock, p.reorder_level, p.is_active
    FROM m_products p LEFT JOIN j_paths c ON p.category_id = c.category_id
      LEFT JOIN j_sold s ON p.product_id = s.product_id
    GROUP BY p.product_id, p.sku, p.product_name, c.category_name, c.category_hierarchy, p.cost, p.price,
      p.stock_quantity, p.reorder_level, p.is_active)"""

CTES["j_balance"] = "SELECT product_id, CAST(sum(quantity) AS BIGINT) AS balance FROM m_moves GROUP BY product_id"
_BALANCE = "coalesce(b.balance, 0)"
CTES["j_inventory"] = f"""
  SELECT p.product_id, p.sku, p.product_name, p.stock_quantity AS system_stock, {_BALANCE} AS calculated_stock,
    p.reorder_level,
    CASE WHEN {_BALANCE} <= p.reorder_level THEN 'reorder' WHEN {_BALANCE} <= 0 THEN 'out_of_stock'
      ELSE 'in_stock' END AS stock_status
  FROM m_products p LEFT JOIN j_balance b ON p.product_id = b.product_id WHERE p.is_active"""

_EDGE = sql_month(NOW)
CTES["c_first"] = f"""
  SELECT customer_id, min({sql_month("created_at")}) AS cohort, max({sql_month("created_at")}) AS final
  FROM m_live GROUP BY customer_id"""
CTES["c_grid"] = f"""
  SELECT cohort, count(*) AS size, unnest(range(0, {_EDGE} - cohort + 1)) AS period FROM c_first GROUP BY cohort"""
CTES["c_facts"] = f"""
  SELECT f.cohort, {sql_month("o.created_at")} - f.cohort AS period, count(DISTINCT o.customer_id) AS active,
    count(*) AS orders, CAST(sum(o.total_amount) AS DECIMAL(38,2)) AS revenue
  FROM m_live o JOIN c_first f ON o.customer_id = f.customer_id GROUP BY 1, 2"""
CTES["c_left"] = "SELECT cohort, final - cohort + 1 AS period, count(*) AS churned FROM c_first GROUP BY 1, 2"
CTES["j_cohorts"] = f"""
  SELECT CAST(make_date(g.cohort // 12, g.cohort % 12 + 1, 1) AS DATE) AS cohort_month,
    CAST(g.period AS BIGINT) AS period_number, g.size AS customers_in_cohort,
    coalesce(a.active, 0) AS active_customers,
    {sql_percent("coalesce(a.active, 0)", "g.size")} AS retention_rate,
    CAST(coalesce(a.revenue, 0) AS DECIMAL(38,2)) AS total_revenue,
    {sql_mean_money("coalesce(a.revenue, 0)", "g.size")} AS avg_revenue_per_customer,
    CAST(sum(coalesce(a.revenue, 0)) OVER (PARTITION BY g.cohort ORDER BY g.period) AS DECIMAL(38,2))
      AS cumulative_revenue,
    CAST(coalesce(a.orders, 0) AS BIGINT) AS total_orders,
    coalesce({sql_mean_money("coalesce(a.orders, 0)", "coalesce(a.active, 0)")}, CAST(0 AS DECIMAL(18,2)))
      AS avg_orders_per_customer,
    CASE WHEN g.period = 0 THEN g.size ELSE 0 END AS new_customers_this_period,
    coalesce(l.churned, 0) AS churned_customers_this_period
  FROM c_grid g LEFT JOIN c_facts a ON g.cohort = a.cohort AND g.period = a.period
    LEFT JOIN c_left l ON g.cohort = l.cohort AND g.period = l.period"""

CTES["d_median"] = f"""
  SELECT d AS summary_date, {sql_mean_money("sum(total_amount)", "count(*)")} AS median_order_value FROM (
    SELECT CAST(created_at AS DATE) AS d, total_amount,
      row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY total_amount) AS r,
      count(*) OVER (PARTITION BY CAST(created_at AS DATE)) AS n
    FROM m_live) WHERE r IN ((n + 1) // 2, n // 2 + 1) GROUP BY d"""

CTES["d_products"] = """
  SELECT CAST(created_at AS DATE) AS summary_date, CAST(sum(quantity) AS BIGINT) AS total_products_sold,
    count(DISTINCT product_id) AS unique_products_sold
  FROM j_sold GROUP BY 1"""


def _top_place(column: str) -> str:
    return f"""
  SELECT summary_date, {column} AS top_{column}, n AS top_{column}_orders FROM (
    SELECT CAST(o.created_at AS DATE) AS summary_date, a.{column}, count(*) AS n,
      row_number() OVER (PARTITION BY CAST(o.created_at AS DATE) ORDER BY count(*) DESC, a.{column}) AS r
    FROM m_live o JOIN m_addresses a ON o.shipping_address_id = a.address_id
    GROUP BY CAST(o.created_at AS DATE), a.{column}) WHERE r = 1"""


CTES["d_city"] = _top_place("city")
CTES["d_state"] = _top_place("state")
CTES["d_category"] = """
  SELECT summary_date, category_name AS top_category, CAST(revenue AS DECIMAL(38,2)) AS top_category_revenue,
    orders AS top_category_orders
  FROM (
    SELECT CAST(s.created_at AS DATE) AS summary_date, c.category_name, sum(s.total_price) AS revenue,
      count(DISTINCT s.order_id) AS orders,
      row_number() OVER (PARTITION BY CAST(s.created_at AS DATE)
        ORDER BY sum(s.total_price) DESC, c.category_name) AS r
    FROM j_sold s JOIN m_products p ON s.product_id = p.product_id
      JOIN m_categories c ON p.category_id = c.category_id
    GROUP BY CAST(s.created_at AS DATE), c.category_name) WHERE r = 1"""
CTES["d_status"] = """
  SELECT CAST(created_at AS DATE) AS summary_date, count(*) FILTER (payment_status = 'paid') AS paid_orders,
    count(*) FILTER (payment_status = 'pending') AS pending_orders,
    count(*) FILTER (order_status = 'cancelled') AS cancelled_orders,
    count(*) FILTER (order_status = 'refunded') AS refunded_orders
  FROM m_orders GROUP BY 1"""
CTES["d_processing"] = """
  SELECT CAST(created_at AS DATE) AS summary_date,
    CAST(sum(date_diff('hour', created_at, shipped_at)) AS DOUBLE) / count(*) AS avg_processing_time_hours,
    count(*) FILTER (CAST(shipped_at AS DATE) = CAST(created_at AS DATE)) AS same_day_shipments
  FROM (SELECT o.order_id, o.created_at, min(l_shipdate) AS shipped_at
    FROM m_live o JOIN lineitem ON o.order_id = l_orderkey WHERE l_shipdate >= o.created_at
    GROUP BY o.order_id, o.created_at)
  GROUP BY 1"""
CTES["j_report"] = """
  SELECT d.*, m.median_order_value, coalesce(p.total_products_sold, 0) AS total_products_sold,
    coalesce(p.unique_products_sold, 0) AS unique_products_sold, c.top_city,
    coalesce(c.top_city_orders, 0) AS top_city_orders, s.top_state,
    coalesce(s.top_state_orders, 0) AS top_state_orders, g.top_category, g.top_category_revenue,
    coalesce(g.top_category_orders, 0) AS top_category_orders, t.paid_orders, t.pending_orders,
    t.cancelled_orders, t.refunded_orders, x.avg_processing_time_hours,
    coalesce(x.same_day_shipments, 0) AS same_day_shipments,
    month(d.summary_date) = 12 AND day(d.summary_date) = 25 AS is_holiday
  FROM j_daily d LEFT JOIN d_median m USING (summary_date) LEFT JOIN d_products p USING (summary_date)
    LEFT JOIN d_city c USING (summary_date) LEFT JOIN d_state s USING (summary_date)
    LEFT JOIN d_category g USING (summary_date) LEFT JOIN d_status t USING (summary_date)
    LEFT JOIN d_processing x USING (summary_date)"""
