from datetime import date, datetime
from decimal import Decimal as D

import pytest

from merchantry import schemas
from merchantry.plans import products, sales
from merchantry.rules import Rules
from merchantry.sources import shared
from tests.test_customers import order

NOW = "2024-01-31 00:00:00"
R = Rules.reference()


def items(spark, *lines):
    return spark.createDataFrame([(o, p, q, D(u), D(u) * q) for o, p, q, u in lines], schemas.ORDER_ITEMS)


def shoppers(spark, *pairs):
    return spark.createDataFrame([(i, datetime.fromisoformat(t)) for i, t in pairs], "customer_id bigint, created_at timestamp_ntz")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [
            order(1, 1, "10.00", "2024-01-05 09:00:00"),
            order(2, 1, "20.01", "2024-01-05 23:59:59"),
            order(3, 2, "30.00", "2024-01-05 00:00:00"),
            order(4, 2, "50.00", "2024-01-06 10:00:00"),
            order(5, 3, "70.00", "2024-01-06 10:00:00", "cancelled"),
            order(6, 3, "80.00", "2024-01-07 10:00:00", "cancelled"),
        ],
        schemas.ORDERS,
    )


def test_daily_summary(spark, orders, rows):
    people = shoppers(spark, (1, "2024-01-04 00:00:00"), (2, "2024-01-03 23:59:59"), (3, "2020-01-01"))
    daily = sales.daily_sales_summary(orders, people, NOW)
    columns = ["summary_date", "total_orders", "total_order_value", "avg_order_value", "total_customers", "new_customers", "returning_customers", "day_of_week", "is_weekend"]
    # the seventh has cancelled orders only and so no row
    assert rows(daily, *columns) == [
        (date(2024, 1, 5), 3, D("60.01"), D("20.00"), 2, 1, 1, "Friday", False),
        (date(2024, 1, 6), 1, D("50.00"), D("50.00"), 1, 0, 1, "Saturday", True),
    ]


def test_daily_parts(spark, orders, rows):
    sold = items(spark, (1, 1, 2, "3.00"), (1, 2, 1, "1.00"), (1, 1, 1, "3.00"), (2, 2, 1, "9.00"), (4, 9, 5, "1.00"), (5, 1, 7, "1"))
    goods = spark.createDataFrame([(1, "x"), (2, "y")], "product_id bigint, category_id string")
    names = spark.createDataFrame([("x", "Xs"), ("y", "Ys")], "category_id string, category_name string")
    mix = sales.daily_product_mix(orders, sold, goods, names)
    assert rows(mix) == [
        (date(2024, 1, 5), 5, 2, "Ys", D("10.00"), 2),
        (date(2024, 1, 6), 5, 1, None, None, None),
    ]
    assert rows(sales.daily_median(orders)) == [(date(2024, 1, 5), D("20.01")), (date(2024, 1, 6), D("50.00"))]
    status = rows(sales.daily_status_counts(orders), "summary_date", "paid_orders", "cancelled_orders")
    assert status == [(date(2024, 1, 5), 3, 0), (date(2024, 1, 6), 2, 1), (date(2024, 1, 7), 1, 1)]


def test_processing_ignores_shipments_before_the_order(spark, orders, rows):
    sent = spark.createDataFrame(
        [(1, datetime(2024, 1, 4)), (1, datetime(2024, 1, 5, 12)), (1, datetime(2024, 1, 9)), (3, datetime(2024, 1, 7)), (4, datetime(2024, 1, 1))],
        "order_id bigint, shipped_at timestamp_ntz",
    )
    assert rows(sales.daily_processing(orders, sent)) == [(date(2024, 1, 5), (3 + 48) / 2, 1)]


def test_top_places_break_ties_by_name(spark, orders, rows):
    places = spark.createDataFrame([(1, "Rome", "B"), (2, "Oslo", "A"), (3, "Bern", "C")], "address_id bigint, city string, state string")
    assert rows(sales.daily_top_places(orders, places)) == [
        (date(2024, 1, 5), "Rome", 2, "B", 2),
        (date(2024, 1, 6), "Oslo", 1, "A", 1),
    ]


def test_report_takes_more_partitions_for_more_rows(spark, orders, rows, monkeypatch):
    sold = items(spark, (1, 1, 2, "3.00"), (1, 2, 1, "1.00"), (2, 2, 1, "9.00"), (4, 9, 5, "1.00"), (5, 1, 7, "1"), (None, None, 1, "1"))
    goods = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "product_id bigint, category_id string")
    names = spark.createDataFrame([("x", "Xs"), ("y", "Ys")], "category_id string, category_name string")
    places = spark.createDataFrame([(1, "Rome", "B"), (2, "Oslo", "A")], "address_id bigint, city string, state string")
    sent = spark.createDataFrame([(1, datetime(2024, 1, 9)), (4, None)], "order_id bigint, shipped_at timestamp_ntz")
    people = shoppers(spark, (1, "2024-01-04 00:00:00"), (2, "2024-01-03 23:59:59"))
    settings = (shared.PARTITIONS, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before, ran_with = [spark.conf.get(k, None) for k in settings], []

    def noted(df, purpose):
        ran_with.append([spark.conf.get(k) for k in settings])
        return shared.written(df, purpose)

    def report():
        return sales.daily_sales_report(orders, people, sold, goods, names, places, sent, NOW)

    lazily = rows(report())
    monkeypatch.setattr(sales, "written", noted)
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 1)
    assert rows(report()) == lazily and len(lazily) == 2
    assert ran_with == [["6", "8m", "16m"]]  # six orders and six lines, where the session has four partitions
    assert [spark.conf.get(k, None) for k in settings] == before
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 2)
    assert rows(report()) == lazily and len(ran_with) == 1


def test_backfill_recomputes_seven_full_days_only(spark, rows):
    placed = spark.createDataFrame(
        [order(i, 1, "10", f"2024-01-{day:02d} 08:00:00") for i, day in enumerate(range(20, 32))], schemas.ORDERS
    )
    people = shoppers(spark, (1, "2023-01-01"))
    old = sales.daily_sales_summary(placed.where("created_at < '2024-01-28'"), people, "2024-01-28 00:00:00")
    after = sales.backfill_daily(old, placed, people, "2024-01-31 09:30:00", R)
    stamps = {r.summary_date.day: r.last_calculated_at.day for r in after.collect()}
    assert stamps == {**{d: 28 for d in range(20, 24)}, **{d: 31 for d in range(24, 31)}}


def test_monthly_trend_averages_daily_averages(spark, rows):
    daily = spark.createDataFrame(
        [
            (date(2024, 1, 1), 1, D("10.00"), D("10.00"), 1, 1),
            (date(2024, 1, 2), 3, D("90.00"), D("30.00"), 2, 0),
            (date(2022, 1, 30), 9, D("9.00"), D("1.00"), 9, 9),
        ],
        "summary_date date, total_orders bigint, total_order_value decimal(18,2), avg_order_value decimal(18,2), total_customers bigint, new_customers bigint",
    )
    assert rows(sales.monthly_sales_trend(daily, NOW, R)) == [("2024-01", 4, D("100.00"), 20.0, 1, 1.5)]


def test_daily_range_includes_both_ends(spark, orders):
    daily = sales.daily_sales_summary(orders, shoppers(spark, (1, "2020-01-01"), (2, "2020-01-01")), NOW)
    assert [r.summary_date.day for r in sales.daily_range(daily, "2024-01-05", "2024-01-06").collect()] == [6, 5]


@pytest.fixture
def goods(spark):
    return spark.createDataFrame(
        [
            (1, "c", "A", "Apple", "apple", None, D("10.00"), D("4.00"), True, 5, 3),
            (2, "c", "B", "Brick", "brick", None, D("20.00"), None, True, 5, 3),
            (3, None, "C", "Chair", "chair", None, D("0.00"), D("1.00"), True, 5, -2),
            (4, "c", "D", "Desk", "desk", None, D("1.00"), D("1.00"), False, 5, 3),
        ],
        schemas.PRODUCTS,
    )


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(
        [("r", None, "Root"), ("m", "r", "Middle"), ("c", "m", "Leaf"), ("o", "gone", "Orphan")],
        "category_id string, parent_category_id string, category_name string",
    )


def test_product_performance(spark, orders, goods, tree):
    sold = items(spark, (1, 1, 2, "9.00"), (2, 1, 1, "9.00"), (4, 1, 1, "9.00"), (1, 2, 1, "20.00"), (5, 3, 1, "1.00"))
    table = {r.product_id: r for r in products.product_performance(goods, sold, orders, tree, NOW, R).collect()}
    apple, brick, chair = table[1], table[2], table[3]
    assert (apple.total_quantity_sold, apple.total_revenue, apple.total_cost, apple.total_profit) == (4, D("36.00"), D("16.00"), D("20.00"))
    assert (apple.profit_margin_percent, apple.total_orders, apple.unique_customers) == (D("55.56"), 3, 2)
    assert (apple.avg_quantity_per_order, apple.avg_revenue_per_order) == (D("1.33"), D("12.00"))
    assert (apple.category_hierarchy, apple.days_since_last_sale, apple.velocity_category) == ("Root > Middle > Leaf", 25, "slow")
    assert (brick.total_cost, brick.total_profit, brick.profit_margin_percent) == (None, None, None)
    # sold in a cancelled order only
    assert (chair.total_orders, chair.total_revenue, chair.profit_margin_percent, chair.category_name) == (0, D("0.00"), None, None)
    limited = products.product_performance(goods, sold, orders, tree, NOW, R, ("2024-01-06", "2024-01-06"))
    assert {r.product_id: r.total_quantity_sold for r in limited.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_product_ranks(spark, goods, tree, orders):
    sold = items(spark, (1, 1, 2, "9.00"), (2, 2, 2, "9.00"), (4, 3, 1, "1.00"))
    table = products.product_performance(goods, sold, orders, tree, NOW, R)
    ranked = products.top_performing_products(table).select("product_id", "revenue_rank", "quantity_rank")
    assert [tuple(r) for r in ranked.collect()] == [(1, 1, 1), (2, 1, 1), (3, 3, 3)]


def test_sums_beyond_sixteen_digits(spark, rows):
    huge = [order(i, 1, "9999999999999999.99", "2024-01-05 09:00:00") for i in range(1, 13)]
    big = spark.createDataFrame(huge, schemas.ORDERS)
    people = shoppers(spark, (1, "2020-01-01"))
    daily = sales.daily_sales_summary(big, people, NOW)
    assert rows(daily, "total_order_value", "avg_order_value") == [(D("119999999999999999.88"), D("9999999999999999.99"))]
    assert sales.monthly_sales_trend(daily, NOW, R).first().monthly_revenue == D("119999999999999999.88")


def test_backfill_empties_a_day_that_lost_all_orders(spark, rows):
    people = shoppers(spark, (1, "2020-01-01"))
    before = spark.createDataFrame([order(1, 1, "10.00", "2024-01-30 09:00:00"), order(2, 1, "5.00", "2024-01-29 09:00:00")], schemas.ORDERS)
    after = spark.createDataFrame([order(1, 1, "10.00", "2024-01-30 09:00:00", "cancelled"), order(2, 1, "5.00", "2024-01-29 09:00:00")], schemas.ORDERS)
    stored = sales.daily_sales_summary(before, people, NOW)
    again = sales.backfill_daily(stored, after, people, "2024-01-31 00:00:00", R)
    columns = ["summary_date", "total_orders", "total_order_value", "avg_order_value", "total_customers", "is_weekend"]
    assert rows(again, *columns) == [
        (date(2024, 1, 29), 1, D("5.00"), D("5.00"), 1, False),
        (date(2024, 1, 30), 0, D("0.00"), None, 0, False),
    ]


def test_inventory_states(spark, goods, rows):
    moves = spark.createDataFrame(
        [(1, "in", 15, "purchase", 1, None, "x"), (1, "out", -1, "sale", 1, None, "x"), (2, "out", -4, "sale", 1, None, "x"), (4, "in", 9, "purchase", 1, None, "x")],
        schemas.INVENTORY_MOVEMENTS,
    )
    literal = rows(products.product_inventory(goods, moves), "product_id", "calculated_stock", "stock_status")
    # product 3 never moved; its level below zero is the only way to reach out_of_stock
    assert literal == [(1, 14, "in_stock"), (2, -4, "reorder"), (3, 0, "out_of_stock")]
    strict = rows(products.product_inventory(goods, moves, strict=True), "product_id", "stock_status")
    assert strict == [(1, "in_stock"), (2, "out_of_stock"), (3, "out_of_stock")]
    assert products.low_stock(products.product_inventory(goods, moves)).count() == 2
    assert products.inventory_lookup(products.product_inventory(goods, moves), "A").count() == 1


def test_category_paths(tree, rows):
    assert rows(products.category_paths(tree), "category_id", "category_hierarchy", "depth") == [
        ("c", "Root > Middle > Leaf", 3),
        ("m", "Root > Middle", 2),
        ("o", "Orphan", 1),
        ("r", "Root", 1),
    ]


def test_category_cycle_is_an_error(spark):
    loop = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B")], "category_id string, parent_category_id string, category_name string")
    from merchantry.operators.joins import hierarchy_paths

    with pytest.raises(ValueError, match="cycle"):
        hierarchy_paths(loop, "category_id", "parent_category_id", "category_name", max_rounds=3)


def test_public_columns(goods):
    assert products.public_products(goods).columns == ["product_id", "sku", "product_name", "price", "is_active"]
