"""The maintained customer figures against a rebuild, and what they read."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from merchantry.plans import maintained as m
from merchantry.plans.audit import capture_changes

CHANGE = f"old struct<{m.IMAGE}>, new struct<{m.IMAGE}>"
DAY = datetime(2001, 1, 1)


def order(rng, order_id, customer=None):
    return (
        order_id,
        customer if customer is not None else rng.choice([1, 1, 1, 2, 3, rng.randrange(40)]),
        rng.choice(["pending", "delivered", "cancelled"]),
        rng.choice([None, Decimal("5.00"), Decimal(rng.randrange(9)), Decimal("99.99")]),
        DAY + timedelta(days=rng.randrange(6)),
        rng.choice([None, 1, 2]),
    )


def history(seed):
    """Orders before and after some rounds of changes, and the changes one by one."""
    rng = random.Random(seed)
    before = {i: order(rng, i) for i in range(60)}
    now, changes = dict(before), []
    for _ in range(rng.choice([0, 5, 80])):
        known = rng.choice([*now, None])
        old = now.pop(known) if known is not None else None
        new = None
        if old is None or rng.random() < 0.7:  # else a deletion
            new = order(rng, len(before) + len(changes) if old is None else old[0])
            now[new[0]] = new
        changes.append((old, new))
    rng.shuffle(changes)
    return list(before.values()), list(now.values()), changes


@pytest.mark.parametrize("listed", [1000, 0])
@pytest.mark.parametrize("seed", range(6))
def test_figures_equal_a_rebuild(spark, rows, monkeypatch, seed, listed):
    monkeypatch.setattr(m, "LISTED_KEYS", listed)
    before, after, changes = history(seed)
    facts = spark.createDataFrame(after, m.IMAGE)
    log = spark.createDataFrame(changes, CHANGE)
    got = m.updated_figures(m.first_figures(spark.createDataFrame(before, m.IMAGE)), log, facts)
    wanted = m.first_figures(facts).fillna({"units": 0})  # units of no items count as none
    assert got.dtypes == wanted.dtypes
    assert rows(got) == rows(wanted)


def test_the_log_of_two_snapshots(spark, rows):
    before, after, _ = history(5)
    old, new = (spark.createDataFrame(x, m.IMAGE) for x in (before, after))
    changes = m.logged_orders(capture_changes(old, new, "order_id", "orders", "2001-02-01"), "orders")
    got = m.updated_figures(m.first_figures(old), changes, new)
    assert rows(got) == rows(m.first_figures(new).fillna({"units": 0}))
    assert m.logged_orders(capture_changes(old, new, "order_id", "other", "2001-02-01"), "orders").isEmpty()


def figures_and_guard(spark, allowed):
    """Figures of three customers, and facts that end the job if others than `allowed` are read."""
    facts = [(i, i % 3, "pending", Decimal(10 + i), DAY + timedelta(days=i), 1) for i in range(9)]
    df = spark.createDataFrame(facts, m.IMAGE)
    checked = F.when(F.col("customer_id").isin(allowed), F.col("total_amount")).otherwise(F.raise_error(F.lit("read")))
    return facts, m.first_figures(df), df.where("order_id <> 6").withColumn("total_amount", checked.cast("decimal(18,2)"))


def test_orders_are_not_read_while_extremes_stay(spark):
    facts, figures, guard = figures_and_guard(spark, [])
    middle = facts[3]  # neither first nor last of customer 0
    log = spark.createDataFrame([(middle, None), (None, (20, 1, "pending", Decimal(1), DAY, 4))], CHANGE)
    got = {r["customer_id"]: r for r in m.updated_figures(figures, log, guard).collect()}
    assert (got[0]["total_orders"], got[0]["spent"]) == (2, Decimal("26.00"))
    assert (got[1]["lowest"], got[1]["first_order_date"], got[1]["units"]) == (Decimal("1.00"), DAY, 7)


@pytest.mark.parametrize("listed", [1000, 0])
def test_only_customers_who_lost_an_extreme_are_read(spark, monkeypatch, listed):
    monkeypatch.setattr(m, "LISTED_KEYS", listed)
    facts, figures, guard = figures_and_guard(spark, [0])
    log = spark.createDataFrame([(facts[6], None)], CHANGE)
    got = {r["customer_id"]: r["highest"] for r in m.updated_figures(figures, log, guard).collect()}
    assert got == {0: Decimal("13.00"), 1: Decimal("17.00"), 2: Decimal("18.00")}
