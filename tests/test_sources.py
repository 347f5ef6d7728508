from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry.plans.products import product_sales
from merchantry.sources import shared
from merchantry.sources.adapter import Model
from merchantry.sources.sinks import load, merge_upsert, save_bucketed, upsert_table
from merchantry.sources.snapshot import changes_since, export_snapshot, extract_changes, stored_position
from merchantry.sources.tables import jdbc_options, load_tables, stream_table
from merchantry.streaming import jobs

SCHEMA = "k int, a string, b decimal(18,2)"


@pytest.mark.parametrize("small", [False, True])
def test_upsert_changes_supplied_columns_only(spark, rows, small):
    target = spark.createDataFrame([(1, "x", D(1)), (2, "y", D(2)), (3, "z", D(3))], SCHEMA)
    source = spark.createDataFrame([(1, None, "new"), (4, "n", "new")], "k int, a string, unknown string")
    merged = merge_upsert(target, source, ["k"], small_source=small)
    assert merged.columns == target.columns
    assert rows(merged) == [(1, None, D(1)), (2, "y", D(2)), (3, "z", D(3)), (4, "n", None)]


def test_upsert_takes_the_last_of_repeated_keys(spark, rows):
    target = spark.createDataFrame([(1, "x", D(1))], SCHEMA)
    source = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "b", 9), (2, "a", 3)], "k int, a string, seq int")
    assert rows(merge_upsert(target, source, ["k"], ["seq"])) == [(1, "new", D(1)), (2, "b", None)]


def test_upsert_needs_its_keys(spark):
    target = spark.createDataFrame([(1, "x", D(1))], SCHEMA)
    with pytest.raises(ValueError, match="key"):
        merge_upsert(target, target.drop("k"), ["k"])
    with pytest.raises(ValueError, match="key"):
        merge_upsert(target, target, [])


@pytest.mark.parametrize("partition_by", [[], ["p"]])
def test_upsert_table(spark, rows, tmp_path, partition_by):
    path = str(tmp_path / "t")
    schema = "k int, v string, p int"
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], schema)
    second = spark.createDataFrame([(2, "B", 1), (4, "d", 3)], schema)
    upsert_table(spark, path, first, ["k"], partition_by=partition_by)
    for _ in range(2):  # a second run of the same batch changes nothing
        upsert_table(spark, path, second, ["k"], partition_by=partition_by)
        assert rows(spark.read.parquet(path), "k", "v", "p") == [(1, "a", 1), (2, "B", 1), (3, "c", 2), (4, "d", 3)]


def test_upsert_leaves_untouched_partitions_alone(spark, tmp_path):
    path = tmp_path / "t"
    schema = "k int, v string, p int"
    upsert_table(spark, str(path), spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema), ["k"], partition_by=["p"])
    before = {f.name for f in (path / "p=2").glob("*.parquet")}
    upsert_table(spark, str(path), spark.createDataFrame([(1, "A", 1)], schema), ["k"], partition_by=["p"])
    assert {f.name for f in (path / "p=2").glob("*.parquet")} == before


def test_cut_off_swap_is_recovered(spark, rows, tmp_path):
    path = tmp_path / "t"
    upsert_table(spark, str(path), spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    path.rename(tmp_path / "t__replaced")
    upsert_table(spark, str(path), spark.createDataFrame([(2, "b")], "k int, v string"), ["k"])
    assert rows(spark.read.parquet(str(path))) == [(1, "a"), (2, "b")]


def test_load_modes(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i,)], "k int") for i in (1, 2))
    load(one, path, "replace")
    load(two, path, "append")
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]
    load(two, path, "replace")
    assert rows(spark.read.parquet(path)) == [(2,)]
    with pytest.raises(ValueError, match="load method"):
        load(one, path, "merge")


def test_bucketed_tables_join_in_place(spark, tmp_path):
    model = Model(spark, "/root/testdata/sf0.001")
    for name in ("orders", "order_items"):
        save_bucketed(getattr(model, name), f"bucketed_{name}", "order_id", 4, str(tmp_path / name))
    orders, items = spark.table("bucketed_orders"), spark.table("bucketed_order_items")
    sold = product_sales(items, orders)
    plan = sold._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan
    assert sold.count() == product_sales(model.order_items, model.orders).count()
    for name in ("orders", "order_items"):
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_snapshot_is_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    manifest = export_snapshot(df, str(tmp_path / "s"))
    assert (manifest.rows, manifest.verified) == (3, True)
    other = export_snapshot(df.distinct(), str(tmp_path / "d"))
    assert other.checksum != manifest.checksum
    assert not export_snapshot(df.limit(0), str(tmp_path / "e")).verified


def test_snapshot_notices_a_nondeterministic_copy(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "s")
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: real(self, *p).where("k = 1"))
    assert not export_snapshot(df, path).verified


def test_extract_stores_and_advances_its_position(spark, rows, tmp_path):
    out, position = str(tmp_path / "out"), str(tmp_path / "position")
    data = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))]

    def run():
        return extract_changes(spark.createDataFrame(data, "k bigint, t timestamp_ntz"), "t", "k", out, position)

    assert stored_position(spark, position) is None
    assert (run(), run()) == (2, 0)
    data += [(3, datetime(2024, 1, 2)), (4, datetime(2024, 1, 3, 5, 6, 7, 89))]  # 3 has the position's own time
    assert (run(), run()) == (2, 0)
    assert rows(spark.read.parquet(out), "k") == [(1,), (2,), (3,), (4,)]
    assert stored_position(spark, position).key == 4


def test_changes_since(spark, rows):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "t string").select(F.col("t").cast("timestamp_ntz"))
    assert changes_since(df, "t", None).count() == 2
    assert changes_since(df, "t", "2024-01-01").count() == 1


def test_filters_and_columns_reach_the_scan(spark):
    model = Model(spark, "/root/testdata/sf0.001")
    recent = model.log.where(F.col("logged_at") >= F.lit("2024-01-30").cast("timestamp_ntz")).select("event_id")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-30" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_tables_without_a_schema_are_inferred(spark):
    tables = load_tables(spark, "/root/testdata/sf0.001", ["nation"], {})
    assert tables["nation"].columns == ["n_nationkey", "n_name", "n_regionkey"]


def test_jdbc_options():
    options = jdbc_options("jdbc:store://h/db", "orders", "order_id", 1, 100, 8)
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ("order_id", "8", "100")
    with pytest.raises(ValueError, match="partitions"):
        jdbc_options("u", "t", "c", 0, 1, 0)


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            assert name == "spark.checkpoint.dir"
            return self.value

    class Session:
        def __init__(self, value, master):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    assert shared.shared_dir(Session("hdfs://c/x/", "yarn"), "p").startswith("hdfs://c/x/merchantry/p-")
    assert "merchantry/p-" in shared.shared_dir(Session(None, "local[2]"), "p")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(None, "yarn"), "p")


@pytest.mark.parametrize("name", ["plain", "slash/", "odd-", "part.parquet"])
def test_stream_reads_any_folder_name(spark, tmp_path, name):
    path = str(tmp_path / name.rstrip("/"))
    spark.range(3).write.parquet(path)
    given = f"{path}/" if name.endswith("/") else path
    out = str(tmp_path / "out")
    query = jobs.incremental_extract(stream_table(spark, given, "id bigint"), out, str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 3
