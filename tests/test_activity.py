"""Bitmaps of active ids against sets, stored retention against the filter, recursive paths."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from merchantry.operators.joins import hierarchy_paths, hierarchy_paths_lazy
from merchantry.plans import activity, audit, retention
from merchantry.rules import Rules
from merchantry.schemas import AUDIT_CONFIG

AS_OF = "2024-03-15 12:00:00"


def bought(spark):
    """(day, id) rows: one id with a third of them, ids at the edges of buckets, negative and NULL ones."""
    rows = [(i % 60, 7) for i in range(600)]
    rows += [(i % 60, (i * i * 31) % 70_000) for i in range(1200)]
    rows += [(3, i) for i in (0, 1, -1, 32_767, 32_768, 32_769, -32_768, 2**40)] + [(40, 0), (55, -1), (3, None)]
    return spark.createDataFrame(rows, "day int, id bigint"), [(d, i) for d, i in rows if i is not None]


def test_activity_equals_sets(spark):
    df, rows = bought(spark)
    days = activity.id_bitmaps(df, ["day"], "id")
    weeks = activity.united(days, [(F.col("day") / 10).cast("int").alias("week")])
    got = {r["week"]: tuple(r)[1:] for r in activity.activity_by_period(weeks, "week", [1, 4]).collect()}
    ids = {w: {i for d, i in rows if d // 10 == w} for w in range(6)}
    for w, own in ids.items():
        earlier = set().union(*[ids[v] for v in range(w)])
        back = [len(own & ids.get(w - n, set())) for n in (1, 4)]
        assert got[w] == (len(own), len(own - earlier), *back)
    assert len(got) == 6


def test_activity_of_nothing_and_with_gaps(spark):
    df, _ = bought(spark)
    none = activity.id_bitmaps(df.where("id IS NULL"), ["day"], "id")
    assert activity.activity_by_period(none, "day", [1]).count() == 0
    gap = activity.id_bitmaps(df.where("day IN (3, 55)"), ["day"], "id")
    got = {r["day"]: tuple(r)[1:] for r in activity.activity_by_period(gap, "day", [1, 52]).collect()}
    assert set(got) == {3, 55} and got[55][2] == 0 and got[55][3] >= 2  # 7 and -1 came back


def log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"t{i % 3}", start + dt.timedelta(hours=6 * i)) for i in range(300)]
    rows += [(900, None, start), (901, "t0", None), (902, "a/b=c", start), (903, "7", dt.datetime(2024, 3, 1))]
    return spark.createDataFrame(rows, "id bigint, table_name string, changed_at timestamp_ntz")


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


@pytest.mark.parametrize("days", [[20, 45, None], [1, 400, 14]])
def test_stored_retention_equals_the_filter(spark, rows, tmp_path, days):
    config = spark.createDataFrame(
        [(f"t{i}", True, True, True, True, None, n) for i, n in enumerate(days)], AUDIT_CONFIG
    )
    rules, df, path = Rules(audit_retention_days=60), log(spark), str(tmp_path / "log")
    retention.save_log(df, path)
    before = files(path)
    done = retention.expire(spark, path, df.schema, config, AS_OF, rules)
    wanted = audit.apply_retention(df, config, AS_OF, rules)
    stored = retention.stored_log(spark, path, df.schema)
    assert rows(stored, *df.columns) == rows(wanted)
    assert done["dropped"] > 0 and 0 < done["rewritten"] <= 4
    after = files(path)
    edges = {os.path.dirname(f) for f in after if f not in before}
    assert len(edges) == done["rewritten"]
    untouched = {f: t for f, t in after.items() if f in before}
    assert untouched == {f: before[f] for f in untouched} and untouched
    # once more: nothing is left to do, and no file changes
    assert retention.expire(spark, path, df.schema, config, AS_OF, rules) == {"dropped": 0, "rewritten": 0}
    assert files(path) == after
    assert not any(f.endswith(n) for f in after for n in ("log_month=__HIVE_DEFAULT_PARTITION__",))


def tree(spark, rows):
    return spark.createDataFrame(rows, "id bigint, up bigint, name string")


def test_recursive_paths_equal_the_doubled_ones(spark, rows):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(30)]
    df = tree(spark, [*chain, (100, 5, "side"), (101, 999, "orphan"), (102, 100, None)])
    lazy = hierarchy_paths_lazy(df, "id", "up", "name")
    assert rows(lazy) == rows(hierarchy_paths(df, "id", "up", "name"))


def test_recursive_paths_start_no_job_and_refuse_cycles(spark):
    group = "lazy-paths"
    spark.sparkContext.setJobGroup(group, "")
    df = hierarchy_paths_lazy(tree(spark, [(1, None, "a"), (2, 3, "b"), (3, 2, "c"), (4, 3, "d")]), "id", "up", "name")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0
    with pytest.raises(Exception, match="cycle"):
        df.collect()
