from datetime import date, datetime
from decimal import Decimal as D

import pytest

from merchantry import schemas
from merchantry.functions.classify import customer_segment, lifetime_value_tier
from merchantry.plans import cohorts, customers
from merchantry.rules import Rules

NOW = "2024-01-31 12:00:00"
R = Rules.reference()


def order(i, customer, total, at, status="delivered", address=None):
    a = address or customer
    d = D(total)
    return (i, customer, f"N{i}", status, a, a, d, D(0), D(0), D(0), d, "paid", "card", datetime.fromisoformat(at))


@pytest.fixture
def people(spark):
    made = datetime(2024, 1, 10)
    return spark.createDataFrame(
        [(i, f"P{i}@Shop.com", "Ann", f"Lee{i}", None, None, "active", made, made) for i in (1, 2, 3, 4)],
        schemas.CUSTOMERS,
    )


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [
            order(1, 1, "2698.92", "2024-01-26"),
            order(2, 2, "1255.83", "2024-01-28"),
            order(3, 1, "440.91", "2024-01-30"),
            order(4, 2, "767.91", "2024-01-31", "cancelled"),
            order(5, 3, "10.00", "2024-01-05", "cancelled"),
        ],
        schemas.ORDERS,
    )


@pytest.fixture
def items(spark):
    lines = [(1, 10, 1), (2, 11, 1), (2, 12, 1), (2, 13, 20), (2, 14, 1), (4, 11, 9)]
    return spark.createDataFrame([(o, p, q, D("1.00"), D(q)) for o, p, q in lines], schemas.ORDER_ITEMS)


def test_summary_counts_each_order_once(people, orders, items, rows):
    summary = customers.customer_order_summary(people, orders, items, NOW, R)
    found = rows(summary, "customer_id", "total_orders", "total_spent", "total_products_purchased", "customer_segment")
    assert found == [
        (1, 2, D("3139.83"), 1, "regular"),
        (2, 1, D("1255.83"), 23, "new"),
        (3, 0, D("0.00"), 0, "new"),
        (4, 0, D("0.00"), 0, "new"),
    ]


def test_summary_without_orders_is_zero_and_undated(people, orders, items):
    row = customers.customer_lookup(customers.customer_order_summary(people, orders, items, NOW, R), 3).first()
    assert (row.avg_order_value, row.last_order_date, row.days_since_last_order) == (D("0.00"), None, None)


def test_line_grain_counts_each_order_per_line(people, orders, items, rows):
    summary = customers.customer_order_summary_line_grain(people, orders, items, NOW, R)
    found = rows(summary, "customer_id", "total_orders", "total_spent", "customer_segment")
    assert found[:2] == [(1, 2, D("3139.83"), "regular"), (2, 4, D("5023.32"), "vip")]


def test_recent_summary_keeps_nulls(people, orders, rows):
    recent = customers.recent_customer_summary(people, orders, NOW, R)
    assert rows(recent, "customer_id", "total_orders", "total_spent", "avg_order_value")[2] == (3, 0, D("0.00"), None)
    assert customers.recent_customer_summary(people, orders, "2024-03-01", R).isEmpty()


@pytest.mark.parametrize(
    ("n", "idle", "spent", "segment"),
    [
        (0, None, 0, "new"),
        (5, 366, 9999, "churned"),
        (5, 365, 9999, "at_risk"),
        (5, 181, 9999, "at_risk"),
        (5, 180, 5001, "vip"),
        (5, 180, 5000, "regular"),
        (20, 1, 10, "regular"),
        (21, 1, 10, "vip"),
        (1, 1, 10, "new"),
        (2, 1, 10, "regular"),
    ],
)
def test_segment_boundaries(spark, n, idle, spent, segment):
    df = spark.createDataFrame(
        [(n, idle, D(spent))], "total_orders bigint, days_since_last_order bigint, total_spent decimal(18,2)"
    )
    assert df.select(customer_segment(R)).first()[0] == segment


def test_tier_boundaries(spark):
    spent = ["499.99", "500", "2499.99", "2500", "9999.99", "10000"]
    df = spark.createDataFrame([(D(s),) for s in spent], "total_spent decimal(18,2)")
    tiers = [r[0] for r in df.select(lifetime_value_tier(R)).collect()]
    assert tiers == ["low", "medium", "medium", "high", "high", "premium"]


def test_clean_drops_missing_email_and_ages(spark):
    born = date(1985, 6, 15)
    df = spark.createDataFrame(
        [(1, "Mixed@Case.COM", "A", "B", born), (2, None, "C", "D", born), (3, "x@y.z", "E", "F", None)],
        "customer_id bigint, email string, first_name string, last_name string, date_of_birth date",
    )
    clean = customers.customer_clean(df, NOW, "b1").orderBy("customer_id").collect()
    days = (date(2024, 1, 31) - born).days
    assert [(r.email, r.customer_name, r.age) for r in clean] == [
        ("mixed@case.com", "A B", days // 365),
        ("x@y.z", "E F", None),
    ]
    assert "age" not in customers.customer_clean(df.drop("date_of_birth"), NOW, "b1").columns


def test_geography_prefers_the_used_place_then_the_first_name(spark, rows):
    orders = spark.createDataFrame(
        [
            order(1, 1, "1", "2024-01-01", address=10),
            order(2, 1, "1", "2024-01-02", address=11),
            order(3, 1, "1", "2024-01-03", address=11),
            order(4, 1, "1", "2024-01-04", "cancelled", 10),
            order(5, 1, "1", "2024-01-04", "cancelled", 10),
            order(6, 2, "1", "2024-01-05", address=11),
            order(7, 2, "1", "2024-01-06", address=10),
        ],
        schemas.ORDERS,
    )
    places = spark.createDataFrame([(10, "Austin", "TX", "US"), (11, "Boston", "MA", "US")], "address_id bigint, city string, state string, country string")
    found = rows(customers.customer_geography(orders, places), "customer_id", "primary_shipping_city", "orders_to_place")
    assert found == [(1, "Boston", 2), (2, "Austin", 1)]


def test_an_unknown_category_is_never_the_favourite(spark):
    orders = spark.createDataFrame([order(1, 1, "1", "2024-01-01")], schemas.ORDERS)
    items = spark.createDataFrame([(1, 1, 9, D(1), D(9)), (1, 2, 2, D(1), D(2))], schemas.ORDER_ITEMS)
    products = spark.createDataFrame([(1, None), (2, "c")], "product_id bigint, category_id string")
    categories = spark.createDataFrame([("c", "Cat")], "category_id string, category_name string")
    found = customers.customer_behaviour(orders, items, products, categories).first()
    assert (found.favorite_category, found.total_products_purchased) == ("Cat", 11)


def test_behaviour_breaks_ties_by_name(spark, rows):
    orders = spark.createDataFrame([order(1, 1, "1", "2024-01-01")], schemas.ORDERS)
    items = spark.createDataFrame([(1, 1, 2, D(1), D(2)), (1, 2, 2, D(1), D(2)), (1, 1, 1, D(1), D(1)), (1, 3, 3, D(1), D(3))], schemas.ORDER_ITEMS)
    products = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a2")], "product_id bigint, category_id string")
    categories = spark.createDataFrame([("a", "Apples"), ("a2", "Zebra"), ("b", "Books")], "category_id string, category_name string")
    assert rows(customers.customer_behaviour(orders, items, products, categories)) == [(1, "Books", 8, 3)]


def test_report_joins_all_parts(people, orders, items, spark):
    summary = customers.customer_order_summary(people, orders, items, NOW, R)
    places = spark.createDataFrame([(1, "Austin", "TX", "US")], "address_id bigint, city string, state string, country string")
    behaviour = spark.createDataFrame([(1, "Books", 3, 2)], "customer_id bigint, favorite_category string, total_products_purchased bigint, unique_products_purchased bigint")
    wide = customers.customer_report(summary, customers.customer_geography(orders, places), behaviour)
    by_id = {r.customer_id: r for r in wide.collect()}
    assert (by_id[1].primary_shipping_city, by_id[1].favorite_category, by_id[1].unique_products_purchased) == ("Austin", "Books", 2)
    assert (by_id[2].primary_shipping_city, by_id[2].unique_products_purchased) == (None, 0)


def test_cohort_with_an_empty_month(spark, rows):
    orders = spark.createDataFrame(
        [
            order(1, 1, "10", "2023-10-05"),
            order(2, 2, "20", "2023-10-06"),
            order(3, 1, "30", "2023-12-01"),
            order(4, 1, "5", "2023-12-02"),
            order(5, 3, "7", "2023-12-03"),
            order(6, 1, "99", "2023-11-01", "cancelled"),
            order(7, 1, "99", "2024-05-01"),
        ],
        schemas.ORDERS,
    )
    table = cohorts.customer_cohorts(orders, NOW)
    columns = ["cohort_month", "period_number", "customers_in_cohort", "active_customers", "retention_rate", "total_revenue", "cumulative_revenue", "total_orders", "avg_orders_per_customer", "new_customers_this_period", "churned_customers_this_period"]
    october, december = date(2023, 10, 1), date(2023, 12, 1)
    assert rows(table, *columns) == [
        (october, 0, 2, 2, D("100.00"), D("30.00"), D("30.00"), 2, D("1.00"), 2, 0),
        (october, 1, 2, 0, D("0.00"), D("0.00"), D("30.00"), 0, D("0.00"), 0, 1),
        (october, 2, 2, 1, D("50.00"), D("35.00"), D("65.00"), 2, D("2.00"), 0, 0),
        (october, 3, 2, 0, D("0.00"), D("0.00"), D("65.00"), 0, D("0.00"), 0, 1),
        (december, 0, 1, 1, D("100.00"), D("7.00"), D("7.00"), 1, D("1.00"), 1, 0),
        (december, 1, 1, 0, D("0.00"), D("0.00"), D("7.00"), 0, D("0.00"), 0, 1),
    ]
    assert cohorts.cohorts_since(table, "2023-11-01").count() == 2
