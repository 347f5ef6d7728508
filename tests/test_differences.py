"""Differences of stored snapshots, against the comparison of the whole ones."""

from pyspark.sql import functions as F

from merchantry.plans import differences
from merchantry.plans.audit import capture_changes

NOW = "2024-02-01 00:00:00"
SHOWN = ["operation", "record_id", "old_values", "new_values"]


def snapshots(spark):
    old = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("b")
    )
    changed = F.col("id") % 4999 == 1
    moved = F.col("id") == 30  # NULL and value change places
    new = old.select(
        "id",
        F.when(changed, F.lit(99)).otherwise(F.col("a")).cast("bigint").alias("a"),
        F.when(moved, F.lit("y")).otherwise(F.col("b")).alias("b"),
    ).where("id <> 777")
    return old, new.unionByName(spark.createDataFrame([(50_000, 1, None)], "id bigint, a bigint, b string"))


def test_stored_changes_equal_the_whole_comparison(spark, rows, tmp_path):
    old, new = snapshots(spark)
    differences.save_in_parts(old, "id", f"{tmp_path}/old", 64)
    differences.save_in_parts(new, "id", f"{tmp_path}/new", 64)
    found = differences.stored_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", "id", "t", NOW)
    wanted = capture_changes(old, new, "id", "t", NOW)
    assert rows(found, *SHOWN) == rows(wanted, *SHOWN) and wanted.count() == 8
    parts = differences.differing_parts(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert 0 < len(parts) <= 8
    assert "PartitionFilters: [key_part" in found._jdf.queryExecution().toString().replace("cast(", "")


def test_equal_snapshots_and_other_order(spark, tmp_path):
    old, _ = snapshots(spark)
    differences.save_in_parts(old, "id", f"{tmp_path}/a", 16)
    differences.save_in_parts(old.orderBy(F.desc("id")), "id", f"{tmp_path}/b", 16)
    assert differences.differing_parts(spark, f"{tmp_path}/a", f"{tmp_path}/b") == []
    assert differences.stored_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b", "id", "t", NOW).count() == 0


def test_repeated_rows_and_other_columns_differ(spark, tmp_path):
    old, _ = snapshots(spark)
    differences.save_in_parts(old, "id", f"{tmp_path}/a", 4)
    differences.save_in_parts(old.withColumnRenamed("b", "c"), "id", f"{tmp_path}/b", 4)
    assert differences.differing_parts(spark, f"{tmp_path}/a", f"{tmp_path}/b") == [0, 1, 2, 3]
