"""Heavy hitters against a plain count, on skewed, flat, tied and empty keys."""

from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchantry.operators import heavy


def plain(values, k):
    counts = Counter(values).items()
    return sorted(counts, key=lambda c: (-c[1], c[0] is not None, (c[0] or "").encode()))[:k]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(1, 30), max_size=30), st.integers(1, 10))
def test_reduced_counts_miss_no_more_than_their_bound(counts, counters):
    kept, cut = heavy.reduced(pd.Series(counts, dtype="int64"), counters)
    assert len(kept) <= counters
    assert all(kept.get(v, 0) <= n <= kept.get(v, 0) + cut for v, n in counts.items())
    assert cut * (counters + 1) <= sum(counts.values())


@pytest.mark.parametrize("counters, k", [(8, 3), (64, 3), (64, 10), (5000, 10), (4, 50)])
def test_a_key_with_a_third_of_all_rows(spark, counters, k):
    """Ids 0 to 9 are frequent, 0 most of all; 3,000 others occur twice each."""
    ids = spark.range(30_000, numPartitions=6)
    value = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.col("id") % 10).otherwise(10 + F.col("id") % 3001)
    df = ids.select(F.when(F.col("id") % 500 == 7, None).otherwise(value.cast("string")).alias("v"), F.lit("x").alias("n0"))
    values = [r["v"] for r in df.collect()]
    assert [tuple(r) for r in heavy.heavy_hitters(df, "v", k, counters).collect()] == plain(values, k)


@pytest.mark.parametrize("values", [[], [None], ["b", "a", None], [str(i) for i in range(100)], ["é", "z", "é", "z", "a"]])
def test_ties_nulls_and_nothing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    for k in (1, 3):
        assert [tuple(r) for r in heavy.heavy_hitters(df, "v", k, 2).collect()] == plain(values, k)


def test_what_is_shuffled_does_not_grow_with_the_values(spark):
    counts = [heavy.summaries(spark.range(n, numPartitions=2), "id", 16).count() for n in (1_000, 20_000)]
    assert all(n <= 2 * 17 for n in counts)
