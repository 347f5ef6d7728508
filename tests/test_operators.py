"""Operators against brute force, with one value or group that holds a third of the rows."""

import random
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from merchantry.operators.aggregates import distinct_counts, exact_median, most_frequent, share_of_total
from merchantry.operators.joins import cascade_delete, never_used, resolve_key, set_null_on_delete, small_side
from merchantry.operators.ordering import global_rank, latest_per_key, running_before, running_total, top_k


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    hot = [("hot", D(rng.randrange(0, 5000)) / 100) for _ in range(1000)]
    same = [(f"g{rng.randrange(20)}", D("12.34")) for _ in range(1000)]
    rest = [(f"g{rng.randrange(20)}", D(rng.randrange(-300, 9000)) / 100) for _ in range(994)]
    return hot + same + rest + [("g1", None), ("only_null", None), ("one", D("0.05")), ("two", D("0.01")), ("two", D("0.02")), (None, D("3.00"))]


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_by_buckets(spark, skewed, descending):
    df = spark.createDataFrame(skewed, "g string, v decimal(18,2)")
    got = {r.v: r.r for r in global_rank(df, "v", "r", descending).collect()}

    def key(v):
        return float("-inf") if v is None else v

    values = [v for _, v in skewed]
    if descending:
        wanted = {v: 1 + sum(key(o) > key(v) for o in values) for v in set(values)}
    else:
        wanted = {v: 1 + sum(key(o) < key(v) for o in values) for v in set(values)}
    assert got == wanted
    many = {r.v: r.r for r in global_rank(df, "v", "r", descending, buckets=200).collect()}
    assert many == wanted


def test_global_rank_keeps_every_row(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v decimal(18,2)")
    assert global_rank(df, "v", "r").count() == len(skewed)
    assert global_rank(df.limit(0), "v", "r").count() == 0


def half_up(q: Fraction) -> D:
    cents = q * 100
    whole = int(abs(cents) + Fraction(1, 2))
    return D(whole if cents >= 0 else -whole) / 100


def test_exact_median_with_any_number_of_buckets(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v decimal(18,2)")
    wanted = {}
    for g in {g for g, v in skewed if v is not None}:
        values = sorted(v for h, v in skewed if h == g and v is not None)
        n = len(values)
        wanted[g] = half_up(Fraction(values[(n - 1) // 2] + values[n // 2]) / 2)
    for buckets in (None, 1, 300):
        got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m", buckets).collect()}
        assert got == wanted


def test_exact_median_rounds_once_and_last(spark):
    """Three decimals, negative and very large values, in one form whatever the group's size."""
    values = {
        "three": ["1.005", "1.009", "1.009"],
        "even": ["1.004", "1.005"],
        "negative": ["-1.005", "-7", "-1.004"],
        "large": ["99999999999999999.99", "99999999999999999.98"],
    }
    data = [(g, D(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v decimal(28,3)")
    got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m").collect()}
    assert got == {"three": D("1.01"), "even": D("1.00"), "negative": D("-1.01"), "large": D("99999999999999999.99")}


def test_running_before_spreads_a_large_group(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), F.col("id").alias("v"), F.lit(2).alias("w"))
    placed = running_before(df, "v", "w", "before", ["g"], buckets=64)
    assert placed.where("before <> 2 * v").count() == 0
    assert placed.count() == 20_000


def test_latest_per_key(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, None, "n"), (2, 0, "z")], "k int, o int, v string")
    assert rows(latest_per_key(df, ["k"], ["o"])) == [(1, 3, "c"), (2, 0, "z")]


def test_running_total_and_top_k(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1)], "g string, o int, v int")
    assert rows(running_total(df, ["g"], "o", "v", "t"), "g", "o", "t") == [("a", 1, 5), ("a", 2, 12), ("b", 1, 1)]
    assert [r.v for r in top_k(df, 2, F.desc("v"), F.asc("o")).collect()] == [7, 5]


def test_most_frequent_breaks_ties_by_name(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (2, "x"), (2, "y"), (2, "y")], "k int, n string")
    assert rows(most_frequent(df, ["k"], "n", F.count("*"), "best", "times")) == [(1, "a", 1), (2, "y", 2)]


def test_share_and_distinct_counts(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", 3), ("c", None)], "g string, v int")
    assert rows(share_of_total(df, "g", "n", "p")) == [("a", 3, D("50.00")), ("b", 2, D("33.33")), ("c", 1, D("16.67"))]
    assert rows(distinct_counts(df, ["g"], "v", "n")) == [("a", 2), ("b", 1), ("c", 0)]


def test_anti_join_cascade_and_set_null(spark, rows):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None)], "c int, id int")
    assert rows(never_used(parents, children, "id")) == [(2,)]
    assert rows(cascade_delete(children, "id", parents, "id")) == [(10, 1), (11, 1), (13, None)]
    assert rows(set_null_on_delete(children, "id", parents, "id")) == [(10, 1), (11, 1), (12, None), (13, None)]


def test_resolve_key_gives_null_for_the_unknown(spark, rows):
    names = spark.createDataFrame([("x",), ("y",)], "slug string")
    lookup = spark.createDataFrame([("x", 7)], "category_slug string, category_id int")
    assert rows(resolve_key(names, "slug", lookup, "category_slug", "category_id")) == [("x", 7), ("y", None)]


def test_small_side_is_only_marked_below_the_bound(spark):
    df = spark.range(10)

    def hinted(rows):
        return "broadcast" in small_side(df, rows)._jdf.queryExecution().logical().toString().lower()

    assert hinted(10) and not hinted(9)
