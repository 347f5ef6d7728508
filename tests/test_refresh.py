from datetime import datetime
from decimal import Decimal as D

from merchantry import schemas
from merchantry.plans import refresh
from merchantry.rules import Rules
from tests.test_customers import items, order, orders, people  # noqa: F401  (fixtures)

R = Rules.reference()


def test_recent_customers_update_the_rebuilt_summary(spark, people, orders, items, rows, tmp_path):  # noqa: F811
    path = str(tmp_path / "customer_order_summary")
    refresh.rebuild_customer_summary(path, people, orders, items, "2024-01-31 12:00:00", R)
    later = orders.unionByName(spark.createDataFrame([order(9, 4, "6000.00", "2024-01-31 13:00:00")], schemas.ORDERS))
    refresh.run_all(spark, str(tmp_path), people, later, "2024-02-01 00:00:00", R)
    found = rows(spark.read.parquet(path), "customer_id", "total_orders", "customer_segment", "total_products_purchased")
    # the units are not part of the nightly load and keep their rebuilt value
    assert found == [(1, 2, "regular", 1), (2, 1, "new", 23), (3, 0, "new", 0), (4, 1, "vip", 0)]
    daily = spark.read.parquet(str(tmp_path / "daily_sales_summary"))
    assert rows(daily, "summary_date", "total_order_value") == [
        (datetime(2024, 1, 26).date(), D("2698.92")),
        (datetime(2024, 1, 28).date(), D("1255.83")),
        (datetime(2024, 1, 30).date(), D("440.91")),
        (datetime(2024, 1, 31).date(), D("6000.00")),
    ]
