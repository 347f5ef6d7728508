"""Projections (P), joins (J), aggregates (G), windows (W), order (O), unions (U), functions (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.catalog.jobs import cohort_table, daily, inventory, performance, summary
from merchantry.catalog.model_sql import NOW, R, segment_sql
from merchantry.catalog.registry import (
    AS_OF,
    EVENTS_AS_OF,
    query,
    sql_mean,
    sql_mean_money,
    sql_percent,
    sql_rate,
)
from merchantry.functions import scalar
from merchantry.functions.classify import class_rank, customer_segment
from merchantry.functions.documents import merge_patch, row_image, string_list
from merchantry.functions.scalar import MONEY, before, moment, money, total, within_last, year_month, zero_if_null
from merchantry.operators.aggregates import distinct_counts, exact_median, most_frequent, share_of_total
from merchantry.operators.joins import hierarchy_paths, hierarchy_paths_lazy, never_used, resolve_key
from merchantry.operators.ordering import global_rank, latest_per_key, running_total, top_k
from merchantry.plans import customers, products, sales, sketches
from merchantry.plans.customers import not_cancelled
from merchantry.plans.quality import row_counts, stacked
from merchantry.sources.adapter import Model
from merchantry.sources.shared import written

THEN = f"TIMESTAMP '{EVENTS_AS_OF}'"

# ---- projections, filters, predicates -------------------------------------------------------


@query(
    "p1_projection",
    """SELECT customer_id, email AS customer_email, first_name || ' ' || last_name AS customer_name,
      phone AS customer_phone, CAST(created_at AS DATE) AS customer_created_date FROM m_customers""",
)
def _(m: Model) -> DataFrame:
    return m.customers.select(
        "customer_id",
        F.col("email").alias("customer_email"),
        scalar.full_name("first_name", "last_name").alias("customer_name"),
        F.col("phone").alias("customer_phone"),
        F.to_date("created_at").alias("customer_created_date"),
    )


@query("p2_public_products", "SELECT product_id, sku, product_name, price, is_active FROM m_products")
def _(m: Model) -> DataFrame:
    return products.public_products(m.products)


@query("p2_public_categories", "SELECT category_id, category_name, is_active FROM m_categories")
def _(m: Model) -> DataFrame:
    return products.public_categories(m.categories)


@query(
    "p3_point_lookup",
    """SELECT customer_id, customer_email, customer_name, total_orders, total_spent, avg_order_value,
      customer_segment, last_order_date, days_since_last_order FROM j_summary WHERE customer_id = 42""",
)
def _(m: Model) -> DataFrame:
    return customers.customer_lookup(summary(m), 42)


@query("p4_optional_filter_all", "SELECT * FROM j_inventory")
def _(m: Model) -> DataFrame:
    return products.inventory_lookup(inventory(m))


@query("p4_optional_filter_sku", "SELECT * FROM j_inventory WHERE sku = 'SKU-7'")
def _(m: Model) -> DataFrame:
    return products.inventory_lookup(inventory(m), "SKU-7")


@query(
    "p5_date_range",
    """SELECT summary_date, total_orders, total_order_value, avg_order_value, total_customers, new_customers,
      day_of_week, is_weekend FROM j_daily WHERE summary_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
)
def _(m: Model) -> DataFrame:
    return sales.daily_range(daily(m), "1998-01-01", "1998-03-31")


_SPANS = ["1 hour", "1 day", "7 days", "30 days", "90 days", "24 months"]


@query(
    "p6_relative_time",
    " UNION ALL ".join(
        f"SELECT '{s}' AS span, count(*) AS n FROM m_log WHERE logged_at >= {THEN} - INTERVAL '{s}'" for s in _SPANS
    ),
)
def _(m: Model) -> DataFrame:
    return stacked(
        [
            m.log.where(within_last("logged_at", EVENTS_AS_OF, s)).agg(F.lit(s).alias("span"), F.count("*").alias("n"))
            for s in _SPANS
        ]
    )


@query(
    "p7_in_list",
    """SELECT order_id, order_status, payment_status FROM m_orders
    WHERE order_status IN ('pending', 'refunded') AND payment_status NOT IN ('paid', 'failed')""",
)
def _(m: Model) -> DataFrame:
    wanted = F.col("order_status").isin("pending", "refunded") & ~F.col("payment_status").isin("paid", "failed")
    return m.orders.where(wanted).select("order_id", "order_status", "payment_status")


@query(
    "p8_predicates",
    """SELECT o.order_id, u.units, o.payment_method FROM m_orders o LEFT JOIN j_units u ON o.order_id = u.order_id
    WHERE (u.units IS NULL OR u.units = 0) AND o.payment_status <> 'failed' AND o.payment_method LIKE '1%'""",
)
def _(m: Model) -> DataFrame:
    units = m.order_items.groupBy("order_id").agg(F.sum("quantity").alias("units"))
    empty = F.col("units").isNull() | (F.col("units") == 0)
    kept = empty & (F.col("payment_status") != "failed") & F.col("payment_method").like("1%")
    return m.orders.join(units, "order_id", "left").where(kept).select("order_id", "units", "payment_method")


@query("p9_active_rows", "SELECT product_id, sku, is_active FROM m_products WHERE is_active")
def _(m: Model) -> DataFrame:
    return m.products.where("is_active").select("product_id", "sku", "is_active")


@query(
    "p10_drop_missing_key",
    """SELECT category_id, parent_category_id, category_name FROM m_categories WHERE parent_category_id IS NOT NULL""",
)
def _(m: Model) -> DataFrame:
    kept = m.categories.dropna(subset=["parent_category_id"])
    return kept.select("category_id", "parent_category_id", "category_name")


@query(
    "p11_lineage_columns",
    f"SELECT order_id, total_amount, {NOW} AS processed_at, 'batch_1' AS etl_batch_id FROM m_orders",
)
def _(m: Model) -> DataFrame:
    stamped = m.orders.withColumns({"processed_at": moment(AS_OF), "etl_batch_id": F.lit("batch_1")})
    return stamped.select("order_id", "total_amount", "processed_at", "etl_batch_id")


@query(
    "p12_post_aggregate_filter",
    f"""SELECT * FROM (SELECT customer_id, count(*) AS orders, {sql_mean("sum(total_amount)", "count(*)")} AS average
      FROM m_orders GROUP BY customer_id) WHERE average > 250000""",
)
def _(m: Model) -> DataFrame:
    grouped = m.orders.groupBy("customer_id").agg(F.count("*").alias("orders"), F.sum("total_amount").alias("t"))
    averaged = grouped.select("customer_id", "orders", scalar.mean("t", "orders").alias("average"))
    return averaged.where("average > 250000")


# ---- joins ----------------------------------------------------------------------------------


@query(
    "j1_inner",
    """SELECT o.order_id, o.total_amount, c.email, c.customer_status
    FROM m_orders o JOIN m_customers c ON o.customer_id = c.customer_id""",
)
def _(m: Model) -> DataFrame:
    return m.orders.join(m.customers, "customer_id").select("order_id", "total_amount", "email", "customer_status")


@query(
    "j2_inner_composite",
    """SELECT i.order_id, i.product_id, i.units, v.moved
    FROM (SELECT order_id, product_id, CAST(sum(quantity) AS BIGINT) AS units FROM m_items GROUP BY 1, 2) i
      JOIN (SELECT reference_id, product_id, CAST(sum(quantity) AS BIGINT) AS moved FROM m_moves GROUP BY 1, 2) v
      ON i.order_id = v.reference_id AND i.product_id = v.product_id""",
)
def _(m: Model) -> DataFrame:
    sold = m.order_items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("units"))
    moved = m.inventory_movements.groupBy(F.col("reference_id").alias("order_id"), "product_id")
    return sold.join(moved.agg(F.sum("quantity").alias("moved")), ["order_id", "product_id"])


@query(
    "j3_left_outer",
    """SELECT p.product_id, p.sku, b.balance FROM m_products p LEFT JOIN j_balance b ON p.product_id = b.product_id""",
)
def _(m: Model) -> DataFrame:
    balances = products.stock_balance(m.inventory_movements)
    return m.products.join(balances, "product_id", "left").select("product_id", "sku", "balance")


@query(
    "j4_left_with_on_predicate",
    """SELECT c.customer_id, count(o.order_id) AS refunds, CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2))
      AS refunded FROM m_customers c LEFT JOIN m_orders o ON c.customer_id = o.customer_id
      AND o.order_status = 'refunded' GROUP BY c.customer_id""",
)
def _(m: Model) -> DataFrame:
    refunds = (
        m.orders.where(F.col("order_status") == "refunded")
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("n"), F.sum("total_amount").alias("t"))
    )
    joined = m.customers.select("customer_id").join(refunds, "customer_id", "left")
    return joined.select(
        "customer_id", zero_if_null("n").cast("bigint").alias("refunds"), total(zero_if_null("t")).alias("refunded")
    )


@query(
    "j5_chained_left_joins",
    """SELECT c.customer_id, count(DISTINCT o.order_id) AS orders, CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS units
    FROM m_customers c LEFT JOIN m_live o ON c.customer_id = o.customer_id
      LEFT JOIN m_items i ON o.order_id = i.order_id GROUP BY c.customer_id""",
)
def _(m: Model) -> DataFrame:
    units = m.order_items.groupBy("order_id").agg(F.sum("quantity").alias("u"))
    per_customer = (
        not_cancelled(m.orders)
        .join(units, "order_id", "left")
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("n"), F.sum("u").alias("u"))
    )
    joined = m.customers.select("customer_id").join(per_customer, "customer_id", "left")
    return joined.select(
        "customer_id", zero_if_null("n").cast("bigint").alias("orders"), zero_if_null("u").cast("bigint").alias("units")
    )


@query(
    "j6_left_anti",
    """SELECT o.order_id, o.order_status FROM m_orders o LEFT JOIN m_items i ON o.order_id = i.order_id
    WHERE i.order_id IS NULL""",
)
def _(m: Model) -> DataFrame:
    return never_used(m.orders, m.order_items, "order_id").select("order_id", "order_status")


@query("j7_hierarchy_self_join", "SELECT category_id, category_hierarchy AS path, depth FROM j_paths")
def _(m: Model) -> DataFrame:
    return hierarchy_paths(m.categories, "category_id", "parent_category_id", "category_name")


@query("j7_recursive_paths", "SELECT category_id, category_hierarchy AS path, depth FROM j_paths")
def _(m: Model) -> DataFrame:
    return hierarchy_paths_lazy(m.categories, "category_id", "parent_category_id", "category_name")


@query(
    "j8_key_lookup",
    """SELECT lower(p_type || '/' || p_brand) AS slug, p_partkey AS product_id,
      (SELECT category_id FROM m_categories c WHERE c.category_slug = lower(p_type || '/' || p_brand)) AS category_id
    FROM part""",
)
def _(m: Model) -> DataFrame:
    slugs = m.products.select(F.lower("category_id").alias("slug"), "product_id")
    return resolve_key(slugs, "slug", m.categories, "category_slug", "category_id")


# ---- aggregates -----------------------------------------------------------------------------


@query(
    "g1_grouped_aggregates",
    f"""SELECT order_status, count(*) AS n, CAST(sum(total_amount) AS DECIMAL(38,2)) AS total,
      {sql_mean_money("sum(total_amount)", "count(*)")} AS average, min(total_amount) AS low, max(total_amount) AS high
    FROM m_orders GROUP BY order_status""",
)
def _(m: Model) -> DataFrame:
    grouped = m.orders.groupBy("order_status").agg(
        F.count("*").alias("n"),
        total(F.sum("total_amount")).alias("total"),
        F.min("total_amount").alias("low"),
        F.max("total_amount").alias("high"),
    )
    return grouped.withColumn("average", scalar.mean_money("total", "n"))


@query(
    "g2_count_rows_and_values",
    """SELECT o.order_status, count(*) AS orders, count(u.units) AS orders_with_items
    FROM m_orders o LEFT JOIN j_units u ON o.order_id = u.order_id GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    units = m.order_items.groupBy("order_id").agg(F.sum("quantity").alias("units"))
    joined = m.orders.join(units, "order_id", "left")
    return joined.groupBy("order_status").agg(
        F.count("*").alias("orders"), F.count("units").alias("orders_with_items")
    )


@query(
    "g3_distinct_count",
    """SELECT CAST(created_at AS DATE) AS day, count(DISTINCT customer_id) AS customers FROM m_orders GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return distinct_counts(m.orders.withColumn("day", F.to_date("created_at")), ["day"], "customer_id", "customers")


@query(
    "g4_conditional_distinct_count",
    """SELECT payment_method, count(DISTINCT CASE WHEN order_status = 'cancelled' THEN customer_id END)
      AS customers_who_cancelled FROM m_orders GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    marked = m.orders.withColumn("who", F.when(F.col("order_status") == "cancelled", F.col("customer_id")))
    return distinct_counts(marked, ["payment_method"], "who", "customers_who_cancelled")


@query(
    "g5_conditional_aggregates",
    """SELECT customer_id, count(*) FILTER (order_status = 'delivered') AS delivered,
      count(*) FILTER (order_status = 'cancelled') AS cancelled,
      CAST(coalesce(sum(CASE WHEN payment_status = 'paid' THEN total_amount END), 0) AS DECIMAL(38,2)) AS paid
    FROM m_orders GROUP BY customer_id""",
)
def _(m: Model) -> DataFrame:
    paid = F.sum(F.when(F.col("payment_status") == "paid", F.col("total_amount")))
    return m.orders.groupBy("customer_id").agg(
        F.count_if(F.col("order_status") == "delivered").alias("delivered"),
        F.count_if(F.col("order_status") == "cancelled").alias("cancelled"),
        total(zero_if_null(paid)).alias("paid"),
    )


@query(
    "g6_null_to_zero",
    """SELECT o.order_id, CAST(coalesce(sum(i.total_price), 0) AS DECIMAL(38,2)) AS line_total,
      coalesce(max(i.quantity), 0) AS largest FROM m_orders o LEFT JOIN m_items i ON o.order_id = i.order_id
    GROUP BY o.order_id""",
)
def _(m: Model) -> DataFrame:
    lines = m.order_items.groupBy("order_id").agg(F.sum("total_price").alias("t"), F.max("quantity").alias("q"))
    joined = m.orders.select("order_id").join(lines, "order_id", "left")
    return joined.select(
        "order_id", total(zero_if_null("t")).alias("line_total"), zero_if_null("q").cast("bigint").alias("largest")
    )


@query(
    "g7_global_aggregate",
    """SELECT count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(total_price) AS DECIMAL(38,2)) AS total,
      min(unit_price) AS cheapest, max(unit_price) AS dearest FROM m_items""",
)
def _(m: Model) -> DataFrame:
    return m.order_items.agg(
        F.count("*").alias("n"),
        F.sum("quantity").alias("units"),
        total(F.sum("total_price")).alias("total"),
        F.min("unit_price").alias("cheapest"),
        F.max("unit_price").alias("dearest"),
    )


@query(
    "g8_share_of_total",
    f"""SELECT order_status, count(*) AS orders, {sql_percent("count(*)", "(SELECT count(*) FROM m_orders)")}
      AS percentage FROM m_orders GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return share_of_total(m.orders, "order_status", "orders", "percentage")


@query(
    "g9_ratio_of_sums",
    f"""SELECT product_id, CAST(sum(CASE WHEN movement_type = 'out' THEN -quantity END) AS BIGINT) AS moved_out,
      CAST(sum(CASE WHEN movement_type = 'in' THEN quantity END) AS BIGINT) AS moved_in,
      {sql_mean("sum(CASE WHEN movement_type = 'out' THEN -quantity END)",
                "sum(CASE WHEN movement_type = 'in' THEN quantity END)")} AS out_per_in
    FROM m_moves GROUP BY product_id""",
)
def _(m: Model) -> DataFrame:
    kind = F.col("movement_type")
    sums = m.inventory_movements.groupBy("product_id").agg(
        F.sum(F.when(kind == "out", -F.col("quantity"))).alias("moved_out"),
        F.sum(F.when(kind == "in", F.col("quantity"))).alias("moved_in"),
    )
    return sums.withColumn("out_per_in", scalar.mean("moved_out", "moved_in"))


@query(
    "g10_group_by_expression",
    """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS orders,
      CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue FROM m_orders GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return m.orders.groupBy(scalar.year_month("created_at").alias("month")).agg(
        F.count("*").alias("orders"), total(F.sum("total_amount")).alias("revenue")
    )


MEDIAN_SQL = "SELECT summary_date, median_order_value FROM d_median"


@query("g11_median", MEDIAN_SQL)
def _(m: Model) -> DataFrame:
    return sales.daily_median(m.orders)


@query("g11_median_bucketed", MEDIAN_SQL)
def _(m: Model) -> DataFrame:
    """With more buckets than days have distinct values in some of them."""
    days = not_cancelled(m.orders).withColumn("summary_date", F.to_date("created_at"))
    return exact_median(days, ["summary_date"], "total_amount", "median_order_value", buckets=256)


@query(
    "g11_median_sketched",
    """SELECT strftime(created_at, '%Y-%m') AS sales_month, count(total_amount) AS order_count, true AS median_in_bound
    FROM m_orders WHERE order_status <> 'cancelled' GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    """Medians per month from the stored sketches of days, held against the rows."""
    live = not_cancelled(m.orders).withColumn("sales_month", year_month("created_at"))
    days = sketches.quantile_sketches(live, ["sales_month", F.to_date("created_at").alias("sales_day")], "total_amount")
    stored = written(days, "quantile-sketches")
    months = sketches.merged_quantiles(stored, ["sales_month"], {"median": 0.5})
    held = sketches.rank_shares(live, ["sales_month"], "total_amount", months, "median")
    margin = 2 * sketches.RANK_ERROR
    inside = (F.col("below") <= 0.5 + margin) & (F.col("not_above") >= 0.5 - margin)
    return months.join(held, "sales_month").select(
        "sales_month", F.col("n").alias("order_count"), inside.alias("median_in_bound")
    )


@query(
    "g12_most_frequent",
    """SELECT customer_id, payment_method AS usual_method, n AS times FROM (
      SELECT customer_id, payment_method, count(*) AS n,
        row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_method) AS r
      FROM m_orders GROUP BY 1, 2) WHERE r = 1""",
)
def _(m: Model) -> DataFrame:
    return most_frequent(m.orders, ["customer_id"], "payment_method", F.count("*"), "usual_method", "times")


# ---- windows --------------------------------------------------------------------------------


@query(
    "w1_global_rank",
    """SELECT order_id, product_id, total_price, rank() OVER (ORDER BY total_price DESC) AS price_rank FROM m_items""",
)
def _(m: Model) -> DataFrame:
    return global_rank(m.order_items.select("order_id", "product_id", "total_price"), "total_price", "price_rank")


@query(
    "w1_global_rank_ties",
    """SELECT order_id, product_id, quantity, rank() OVER (ORDER BY quantity) AS quantity_rank FROM m_items""",
)
def _(m: Model) -> DataFrame:
    lines = m.order_items.select("order_id", "product_id", "quantity")
    return global_rank(lines, "quantity", "quantity_rank", descending=False)


@query("w2_cumulative_sum", "SELECT cohort_month, period_number, cumulative_revenue FROM j_cohorts")
def _(m: Model) -> DataFrame:
    revenue = cohort_table(m).select("cohort_month", "period_number", "total_revenue")
    summed = running_total(revenue, ["cohort_month"], "period_number", "total_revenue", "cumulative_revenue")
    return summed.select("cohort_month", "period_number", total("cumulative_revenue").alias("cumulative_revenue"))


@query(
    "w3_latest_per_key",
    """SELECT customer_id, order_id, created_at, total_amount FROM (SELECT *,
      row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC) AS r FROM m_orders)
    WHERE r = 1""",
)
def _(m: Model) -> DataFrame:
    orders = m.orders.select("customer_id", "order_id", "created_at", "total_amount")
    return latest_per_key(orders, ["customer_id"], ["created_at", "order_id"])


# ---- order, limit, union --------------------------------------------------------------------


@query("o1_sort", "SELECT order_id, order_status, created_at, total_amount FROM m_orders")
def _(m: Model) -> DataFrame:
    chosen = m.orders.select("order_id", "order_status", "created_at", "total_amount")
    status = class_rank("order_status", ["pending", "processing", "shipped", "delivered", "cancelled", "refunded"])
    return chosen.orderBy(status, F.desc("created_at"), "order_id")


@query(
    "o2_top_k",
    "SELECT order_id, customer_id, total_amount FROM m_orders ORDER BY total_amount DESC, order_id LIMIT 20",
)
def _(m: Model) -> DataFrame:
    chosen = m.orders.select("order_id", "customer_id", "total_amount")
    return top_k(chosen, 20, F.desc("total_amount"), F.asc("order_id"))


@query(
    "o3_sort_by_expression",
    """SELECT product_id, price, cost FROM m_products ORDER BY price + cost DESC, product_id LIMIT 20""",
)
def _(m: Model) -> DataFrame:
    chosen = m.products.select("product_id", "price", "cost")
    return top_k(chosen, 20, (F.col("price") + F.col("cost")).desc(), F.asc("product_id"))


_MODEL_TABLES = {
    "Categories": ("categories", "m_categories"),
    "Customers": ("customers", "m_customers"),
    "Addresses": ("addresses", "m_addresses"),
    "Products": ("products", "m_products"),
    "Orders": ("orders", "m_orders"),
    "Order Items": ("order_items", "m_items"),
    "Inventory Movements": ("inventory_movements", "m_moves"),
}


@query(
    "u1_union_all",
    " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS record_count FROM {sql}"
        for label, (_, sql) in _MODEL_TABLES.items()
    ),
)
def _(m: Model) -> DataFrame:
    return row_counts({label: getattr(m, name) for label, (name, _) in _MODEL_TABLES.items()})


# ---- scalar functions -----------------------------------------------------------------------


@query("f1_full_name", "SELECT customer_id, first_name || ' ' || last_name AS name FROM m_customers")
def _(m: Model) -> DataFrame:
    return m.customers.select("customer_id", scalar.full_name("first_name", "last_name").alias("name"))


@query("f2_lower_email", "SELECT customer_id, lower(email) AS email FROM m_customers")
def _(m: Model) -> DataFrame:
    return m.customers.select("customer_id", scalar.normalised_email("email").alias("email"))


@query("f3_preview", "SELECT event_id, substring(text, 1, 5) AS text_preview FROM m_log")
def _(m: Model) -> DataFrame:
    return m.log.select("event_id", scalar.preview("text", 5).alias("text_preview"))


@query(
    "f4_coalesce",
    """SELECT category_id, coalesce(parent_category_id, category_id, 'none') AS root FROM m_categories""",
)
def _(m: Model) -> DataFrame:
    root = F.coalesce("parent_category_id", "category_id", F.lit("none"))
    return m.categories.select("category_id", root.alias("root"))


@query(
    "f5_round",
    """SELECT order_id, product_id, CAST(round(total_price, 0) AS DECIMAL(18,2)) AS whole,
      CAST(round(unit_price, 1) AS DECIMAL(18,2)) AS tenths FROM m_items""",
)
def _(m: Model) -> DataFrame:
    return m.order_items.select(
        "order_id",
        "product_id",
        money(F.round("total_price", 0)).alias("whole"),
        money(F.round("unit_price", 1)).alias("tenths"),
    )


@query(
    "f6_as_unsigned",
    """SELECT order_id, TRY_CAST(split_part(payment_method, '-', 1) AS BIGINT) AS priority,
      TRY_CAST(payment_method AS BIGINT) AS not_a_number FROM m_orders""",
)
def _(m: Model) -> DataFrame:
    return m.orders.select(
        "order_id",
        scalar.as_unsigned(F.split_part("payment_method", F.lit("-"), F.lit(1))).alias("priority"),
        scalar.as_unsigned("payment_method").alias("not_a_number"),
    )


@query("f7_to_date", "SELECT event_id, CAST(logged_at AS DATE) AS day FROM m_log")
def _(m: Model) -> DataFrame:
    return m.log.select("event_id", F.to_date("logged_at").alias("day"))


@query("f8_year_month", "SELECT order_id, strftime(created_at, '%Y-%m') AS month FROM m_orders")
def _(m: Model) -> DataFrame:
    return m.orders.select("order_id", scalar.year_month("created_at").alias("month"))


@query(
    "f9_date_difference",
    f"SELECT event_id, CAST(date_diff('day', logged_at, {THEN}) AS BIGINT) AS days FROM m_log",
)
def _(m: Model) -> DataFrame:
    return m.log.select("event_id", scalar.days_since("logged_at", EVENTS_AS_OF).alias("days"))


@query(
    "f10_date_arithmetic",
    f"""SELECT order_id, created_at + INTERVAL 1 MONTH AS next_month, created_at - INTERVAL 1 DAY AS day_before,
      created_at + INTERVAL 5 HOUR AS later, {NOW} - INTERVAL 24 MONTH AS trend_start FROM m_orders""",
)
def _(m: Model) -> DataFrame:
    at = F.col("created_at")
    return m.orders.select(
        "order_id",
        (at + F.expr("INTERVAL 1 MONTH")).alias("next_month"),
        (at - F.expr("INTERVAL 1 DAY")).alias("day_before"),
        (at + F.expr("INTERVAL 5 HOURS")).alias("later"),
        before(AS_OF, "24 months").alias("trend_start"),
    )


@query("f11_day_name", "SELECT order_id, dayname(created_at) AS day_of_week FROM m_orders")
def _(m: Model) -> DataFrame:
    return m.orders.select("order_id", scalar.weekday_name("created_at").alias("day_of_week"))


@query("f12_weekend", "SELECT order_id, dayofweek(created_at) IN (0, 6) AS is_weekend FROM m_orders")
def _(m: Model) -> DataFrame:
    return m.orders.select("order_id", scalar.is_weekend("created_at").alias("is_weekend"))


@query("f13_hour", "SELECT event_id, CAST(hour(logged_at) AS BIGINT) AS hour FROM m_log")
def _(m: Model) -> DataFrame:
    return m.log.select("event_id", F.hour("logged_at").cast("bigint").alias("hour"))


@query("f14_reference_time", f"SELECT order_id, {NOW} AS now, CAST({NOW} AS DATE) AS today FROM m_orders")
def _(m: Model) -> DataFrame:
    return m.orders.select("order_id", moment(AS_OF).alias("now"), F.to_date(moment(AS_OF)).alias("today"))


@query(
    "f15_age_years",
    f"""SELECT customer_id, date_of_birth, CAST(date_diff('day', date_of_birth, CAST({NOW} AS DATE)) // 365 AS BIGINT)
      AS age FROM m_customers""",
)
def _(m: Model) -> DataFrame:
    return m.customers.select("customer_id", "date_of_birth", scalar.age_years("date_of_birth", AS_OF).alias("age"))


@query(
    "f16_searched_case",
    f"""SELECT customer_id, {segment_sql("n", "idle", "spent")} AS segment FROM (
      SELECT customer_id, count(*) AS n, sum(total_amount) AS spent, date_diff('day', max(created_at), {NOW}) AS idle
      FROM m_orders GROUP BY 1)""",
)
def _(m: Model) -> DataFrame:
    grouped = m.orders.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("spent"), F.max("created_at").alias("last")
    )
    idle = grouped.withColumn("idle", scalar.days_since("last", AS_OF))
    return idle.select("customer_id", customer_segment(R, "n", "idle", "spent").alias("segment"))


@query(
    "f17_threshold_bands",
    """SELECT event_id, CASE WHEN duration > 100 THEN 'critical' WHEN duration > 50 THEN 'warning' ELSE 'healthy' END
      AS status FROM m_log""",
)
def _(m: Model) -> DataFrame:
    steps = [(100, "critical"), (50, "warning")]
    return m.log.select("event_id", scalar.band("duration", steps, "healthy", strict=True).alias("status"))


@query(
    "f18_json_object",
    """SELECT category_id, category_name AS name, parent_category_id AS parent, true AS keeps_null FROM m_categories""",
)
def _(m: Model) -> DataFrame:
    image = row_image([F.col("category_name").alias("name"), F.col("parent_category_id").alias("parent")])
    built = m.categories.select("category_id", image.alias("image"))
    return built.select(
        "category_id",
        F.get_json_object("image", "$.name").alias("name"),
        F.get_json_object("image", "$.parent").alias("parent"),
        (F.json_object_keys("image") == string_list("name", "parent")).alias("keeps_null"),
    )


@query(
    "f19_merge_patch",
    """SELECT id, operation, CASE WHEN operation = 'INSERT' THEN new_k WHEN operation = 'DELETE' THEN k ELSE new_k END
      AS k, CASE WHEN operation <> 'DELETE' THEN value END AS value FROM m_audit""",
)
def _(m: Model) -> DataFrame:
    merged = m.audit_log.withColumn("merged", merge_patch("old_values", "new_values"))
    return merged.select(
        "id",
        "operation",
        F.get_json_object("merged", "$.k").cast("bigint").alias("k"),
        F.get_json_object("merged", "$.value").cast(MONEY).alias("value"),
    )


@query(
    "f20_json_array_member",
    "SELECT order_id, list_contains(['pending', 'refunded'], order_status) AS listed FROM m_orders",
)
def _(m: Model) -> DataFrame:
    listed = F.array_contains(string_list("pending", "refunded"), F.col("order_status"))
    return m.orders.select("order_id", listed.alias("listed"))


@query(
    "f21_guarded_rate",
    f"""SELECT user_id, errors, n, {sql_rate("errors", "n")} AS error_rate, {sql_rate("n", "errors")} AS per_error
    FROM (SELECT user_id, count(*) FILTER (is_error) AS errors, count(*) AS n FROM m_log GROUP BY 1)""",
)
def _(m: Model) -> DataFrame:
    counted = m.log.groupBy("user_id").agg(F.count_if("is_error").alias("errors"), F.count("*").alias("n"))
    return counted.withColumns(
        {"error_rate": scalar.rate_or_zero("errors", "n"), "per_error": scalar.rate_or_zero("n", "errors")}
    )


@query(
    "f22_profit_margin",
    f"""SELECT product_id, price, cost, CAST(price - cost AS DECIMAL(18,2)) AS profit,
      {sql_percent("price - cost", "price")} AS margin_percent FROM m_products""",
)
def _(m: Model) -> DataFrame:
    return products.gross_margin(m.products)


@query(
    "f22_profit_per_product",
    "SELECT product_id, total_profit, profit_margin_percent FROM j_perf",
)
def _(m: Model) -> DataFrame:
    return performance(m).select("product_id", "total_profit", "profit_margin_percent")
