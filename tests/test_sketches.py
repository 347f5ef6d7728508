"""Stored sketches against exact figures, on skewed data."""

import math

import pytest
from pyspark.sql import functions as F

from merchantry.plans import sketches as s


@pytest.fixture(scope="module")
def values(spark):
    """Thirty days, of which one has a third of all rows, with heavy tails, ties and nulls."""
    day = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 30)
    value = F.when(F.col("id") % 5 == 0, 1.0).when(F.col("id") % 11 != 0, F.exp(F.rand(3) * 12))
    rows = spark.range(60_000).select(day.alias("day"), value.alias("v"), (F.col("id") % 7001).alias("w"))
    empty = spark.createDataFrame([(31, None, None)] * 3, "day bigint, v double, w bigint")
    return rows.unionByName(empty).persist()


def test_merged_quantiles_keep_their_rank(spark, values):
    days = s.quantile_sketches(values, ["day"], "v")
    assert {r["day"]: r["sketch"] for r in days.collect()}[31] is None
    parts = [(F.col("day") % 4).alias("part")]
    for share in (0.1, 0.5, 0.99):
        merged = s.merged_quantiles(days, parts, {"at": share})
        held = s.rank_shares(values.withColumn("part", F.col("day") % 4), ["part"], "v", merged, "at").collect()
        assert len(held) == 4
        for r in held:
            assert r["below"] - 2 * s.RANK_ERROR <= share <= r["not_above"] + 2 * s.RANK_ERROR
    counts = {r["part"]: r["n"] for r in s.merged_quantiles(days, parts, {"at": 0.5}).collect()}
    assert sum(counts.values()) == values.where("v is not null").count()
    alone = s.merged_quantiles(days.where("day = 31"), ["day"], {"at": 0.5}).first()
    assert (alone["n"], alone["at"]) == (0, None)


def test_united_distinct_sketches_equal_one_over_all_rows(spark, values):
    days = s.distinct_sketches(values, ["day"], ["v", "w"])
    united = {r["column_name"]: r for r in s.merged_selectivity(days).collect()}
    whole = s.merged_selectivity(s.distinct_sketches(values.withColumn("one", F.lit(1)), ["one"], ["v", "w"]))
    assert united.keys() == {"v", "w"}
    for r in whole.collect():
        mine = united[r["column_name"]]
        assert (mine["total_rows"], mine["filled"]) == (r["total_rows"], r["filled"]) and r["total_rows"] == 60_003
        exact = values.select(r["column_name"]).distinct().where(f"{r['column_name']} is not null").count()
        for found in (mine, r):
            assert math.isclose(found["distinct_values"], exact, rel_tol=4 * s.DISTINCT_ERROR)


def test_a_new_day_costs_a_day(spark, values):
    old = s.distinct_sketches(values.where("day <> 7"), ["day"], ["w"])
    new = s.distinct_sketches(values.where("day = 7"), ["day"], ["w"])
    both, whole = (s.merged_selectivity(x).first() for x in (old.union(new), s.distinct_sketches(values, ["day"], ["w"])))
    assert both == whole


def test_nothing(spark, values):
    none = values.where("day > 100")
    assert s.merged_quantiles(s.quantile_sketches(none, ["day"], "v"), ["day"], {"at": 0.5}).count() == 0
    assert s.merged_selectivity(s.distinct_sketches(none, ["day"], ["w"])).count() == 0
