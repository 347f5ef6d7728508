"""A customer summary that is kept up to date from the change log, without a rebuild.

Per customer a table holds the figures of the live orders. Every logged change takes its old
image out and puts its new one in: counts and sums by signed amounts, smallest and largest values
as long as no value taken out was as small or large. Only customers who lost
such a value have their orders read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.scalar import Moment
from merchantry.operators.joins import few, small_side
from merchantry.plans.customers import not_cancelled, order_figures, summary_of
from merchantry.rules import Rules
from merchantry.sources.shared import Scratch, written

IMAGE = "order_id bigint, customer_id bigint, order_status string, total_amount decimal(18,2), created_at timestamp_ntz, units bigint"
FIGURES = "total_orders bigint, spent decimal(38,2), priced bigint, lowest decimal(18,2), highest decimal(18,2), first_order_date timestamp_ntz, last_order_date timestamp_ntz, units bigint"
# an extreme, the order column it is of, and whether it is the smallest
EXTREMES = [
    ("lowest", "total_amount", True),
    ("highest", "total_amount", False),
    ("first_order_date", "created_at", True),
    ("last_order_date", "created_at", False),
]
LISTED_KEYS = 1000


def order_facts(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of IMAGE for every order, cancelled ones too; `units` is NULL without items."""
    units = items.groupBy("order_id").agg(F.sum("quantity").cast("bigint").alias("units"))
    return orders.join(units, "order_id", "left").select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in IMAGE.split(", "))])


def _typed(figures: DataFrame) -> DataFrame:
    kinds = [x.split(" ") for x in FIGURES.split(", ")]
    return figures.select("customer_id", *[F.col(c).cast(t).alias(c) for c, t in kinds])


def first_figures(facts: DataFrame) -> DataFrame:
    """The maintained table from scratch: customer_id and FIGURES of customers with live orders."""
    return _typed(order_figures(not_cancelled(facts).withColumn("copies", F.lit(1).cast("bigint"))))


def logged_orders(log: DataFrame, table: str) -> DataFrame:
    """(old, new) images of the orders that a change log has under `table`, NULL where a side has none."""
    own = log.where(F.col("table_name") == table)
    return own.select(*[F.from_json(f"{side}_values", IMAGE).alias(side) for side in ("old", "new")])


def _signed(changes: DataFrame) -> DataFrame:
    """A row per live image: those of before with sign -1, those of after with 1."""
    sides = [
        F.struct(F.lit(sign).cast("bigint").alias("sign"), F.col(side).alias("order"))
        for side, sign in (("old", -1), ("new", 1))
    ]
    rows = changes.select(F.explode(F.array(*sides)).alias("row")).select("row.sign", "row.order.*")
    return not_cancelled(rows.where("customer_id is not null"))


def figure_changes(changes: DataFrame) -> DataFrame:
    """Per customer the signed counts and sums, and the extremes of what came and what went."""
    sign = F.col("sign")
    amounts = [
        F.sum(sign).alias("d_orders"),
        F.sum(F.col("total_amount") * sign).alias("d_spent"),
        F.sum(F.when(F.col("total_amount").isNotNull(), sign)).alias("d_priced"),
        F.sum(F.col("units") * sign).alias("d_units"),
    ]
    bounds = []
    for name, column, smallest in EXTREMES:
        pick = F.min if smallest else F.max
        bounds += [
            pick(F.when(sign == s, F.col(column))).alias(f"{side}_{name}") for side, s in (("in", 1), ("out", -1))
        ]
    return _signed(changes).groupBy("customer_id").agg(*amounts, *bounds)


def _moved(name: str, smallest: bool) -> tuple[Column, Column]:
    """The extreme after the change, and whether it can only be found among the orders.

    It can be told from the figures if nothing went that is as extreme; what came and went again
    counts on both sides.
    """
    held, came, went = F.col(name), F.col(f"in_{name}"), F.col(f"out_{name}")
    both = F.least(held, came) if smallest else F.greatest(held, came)  # NULLs are passed over
    safe = (went > both) if smallest else (went < both)
    return both, went.isNotNull() & ~F.coalesce(safe, F.lit(False))


def updated_figures(figures: DataFrame, changes: DataFrame, live_facts: DataFrame) -> DataFrame:
    """The maintained table after the changes, as a written table.

    `changes` has old and new images in any order, also several of one order; `live_facts` are the
    order facts as they stand after them. They are read only for customers who lost an extreme:
    up to LISTED_KEYS of them reach the scan as a list, more as a semi join. Without such
    customers the facts are not read at all. Customers left without an order leave the table.
    """
    spark = figures.sparkSession
    with Scratch(spark, "figures") as scratch:
        delta = scratch.written(figure_changes(changes), "delta")
        keyed = small_side(delta.withColumnRenamed("customer_id", "_customer"))
        held = figures.join(keyed, F.col("customer_id") == F.col("_customer"), "left")
        new = delta.join(figures, "customer_id", "left_anti")
        new = new.select("customer_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in FIGURES.split(", "))],
                         F.col("customer_id").alias("_customer"), *[c for c in delta.columns if c != "customer_id"])
        rows = held.unionByName(new)
        zero = F.lit(0).cast("bigint")

        def plus(name: str, change: str) -> Column:
            return F.coalesce(F.col(name), zero) + F.coalesce(F.col(change), zero)

        moved = {name: _moved(name, smallest) for name, _, smallest in EXTREMES}
        priced = plus("priced", "d_priced")
        after = rows.select(
            "customer_id",
            plus("total_orders", "d_orders").alias("total_orders"),
            F.when(priced > 0, plus("spent", "d_spent")).alias("spent"),
            F.when(priced > 0, priced).alias("priced"),
            *[F.when((priced > 0) | F.lit(c != "total_amount"), moved[n][0]).alias(n) for n, c, _ in EXTREMES],
            plus("units", "d_units").alias("units"),
            F.greatest(*[searched for _, searched in moved.values()]).alias("_search"),
        )
        after = scratch.written(after.where("total_orders > 0"), "after")
        lost = after.where("_search").select("customer_id")
        kept = after.where("not _search").drop("_search")
        n = lost.count()
        if n:
            live = not_cancelled(live_facts)
            if n <= LISTED_KEYS:
                live = live.where(F.col("customer_id").isin([r[0] for r in lost.collect()]))
            else:
                live = live.join(F.broadcast(lost) if few(lost) else lost, "customer_id", "left_semi")
            kept = kept.unionByName(first_figures(live))
        return written(_typed(kept), "figures")


def maintained_summary(customers: DataFrame, figures: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    """The customer order summary, equal to a full one, from the maintained table."""
    return summary_of(customers, figures, as_of, rules)

