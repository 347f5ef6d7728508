"""Data quality, audit and monitoring on hand-made rows."""

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry import schemas
from merchantry.plans import audit, monitoring, quality
from merchantry.rules import Rules

NOW = "2024-01-31 12:00:00"


def test_orphans_and_duplicates(spark, rows):
    parents = spark.createDataFrame([(1,)], "id int")
    children = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "fk int")
    assert rows(quality.orphans("c", children, "fk", parents, "id")) == [("c", 3, 2)]
    mails = spark.createDataFrame([("a@x.com",), ("A@X.com",), ("á@x.com",), ("b@x.com",), (None,), (None,)], "email string")
    assert rows(quality.duplicates("m", mails, ["email"])) == [("m", 0, 0)]
    assert rows(quality.duplicates("m", mails, ["email"], any_case=True)) == [("m", 1, 2)]


def test_missing_and_domain(spark, rows):
    df = spark.createDataFrame([("in", None), ("lost", 1), (None, 2)], "kind string, n int")
    assert rows(quality.missing_values("t", df, ["kind", "n"])) == [("t", "kind", 1), ("t", "n", 1)]
    assert rows(quality.outside_domain("t", df, {"kind": ["in", "out"]})) == [("t", "kind", 1)]


def test_arithmetic(spark, rows):
    items = spark.createDataFrame([(1, 1, 3, D("2.00"), D("6.00")), (2, 1, 3, D("2.00"), D("6.01"))], schemas.ORDER_ITEMS)
    assert rows(quality.line_arithmetic(items), "order_id", "difference") == [(2, D("0.01"))]
    orders = spark.createDataFrame(
        [(1, D(6), D(1), D(1), None, D(8)), (2, D(6), None, None, D(1), D(6)), (3, D(0), None, None, None, D(0))],
        "order_id bigint, subtotal decimal(18,2), tax_amount decimal(18,2), shipping_amount decimal(18,2), discount_amount decimal(18,2), total_amount decimal(18,2)",
    )
    assert rows(quality.order_arithmetic(orders, items)) == [(2, D("1.00"), D("-0.01"))]
    unknown = orders.where("order_id = 3").withColumn("total_amount", F.lit(None).cast("decimal(18,2)"))
    assert rows(quality.order_arithmetic(unknown, items)) == [(3, None, D("0.00"))]


def test_capture_changes(spark):
    schema = "id int, name string, secret string, n int"
    old = spark.createDataFrame([(1, "a", "s", 1), (2, "b", "s", None), (3, "c", "s", 3), (4, "d", "s", 4)], schema)
    new = spark.createDataFrame([(1, "a", "changed", 1), (2, "b", "s", 2), (3, None, "s", 3), (5, "e", "s", 5)], schema)
    log = audit.capture_changes(old, new, "id", "things", NOW, {"user": "me"}, exclude=["secret"])
    found = {int(r.record_id): r for r in log.collect()}
    assert {k: r.operation for k, r in found.items()} == {2: "UPDATE", 3: "UPDATE", 4: "DELETE", 5: "INSERT"}
    assert json.loads(found[2].old_values) == {"id": 2, "name": "b", "n": None}
    assert json.loads(found[3].new_values) == {"id": 3, "name": None, "n": 3}
    assert (found[4].new_values, found[5].old_values) == (None, None)
    assert (found[5].changed_by, found[5].application_name, found[5].ip_address, found[5].session_id) == ("me", "Spark-Direct", "unknown", None)


def test_capture_sees_added_and_dropped_columns(spark):
    old = spark.createDataFrame([(1, "x"), (2, None)], "id int, gone string")
    new = spark.createDataFrame([(1, 5), (2, None), (3, None)], "id int, added int")
    found = {int(r.record_id): r for r in audit.capture_changes(old, new, "id", "t", NOW).collect()}
    assert {k: r.operation for k, r in found.items()} == {1: "UPDATE", 3: "INSERT"}
    assert json.loads(found[1].old_values) == {"id": 1, "gone": "x", "added": None}
    assert json.loads(found[1].new_values) == {"id": 1, "gone": None, "added": 5}



@pytest.fixture
def log(spark):
    rows = [
        (1, "a", "INSERT", "1", None, '{"x": 1, "y": 2}', datetime(2024, 1, 31, 11, 30)),
        (2, "a", "UPDATE", "1", '{"x": 1, "y": 2}', '{"x": 3, "y": null}', datetime(2024, 1, 31, 1)),
        (3, "b", "DELETE", "2", '{"x": 9}', None, datetime(2024, 1, 24, 11)),
        (4, "c", "UPDATE", "2", None, '{"x": 9}', datetime(2023, 10, 1)),
    ]
    full = [(*r[:6], "u", r[6], None, None, None, None) for r in rows]
    return spark.createDataFrame(full, schemas.AUDIT_LOG)


def test_audit_trail(log):
    trail = audit.audit_trail(log, NOW, Rules.reference()).collect()
    assert [(r.id, json.loads(r.record_data)) for r in trail] == [(1, {"x": 1, "y": 2}), (2, {"x": 3}), (3, {"x": 9})]


def test_audit_config_and_retention(spark, log, rows):
    config = spark.createDataFrame(
        [("a", True, False, None, True, ["y"], 1), ("b", False, True, True, True, None, 7)], schemas.AUDIT_CONFIG
    )
    passed = {r.id: r for r in audit.apply_audit_config(log, config).collect()}
    assert set(passed) == {2, 4}
    assert json.loads(passed[2].old_values) == {"x": 1}
    assert passed[4].old_values is None
    kept = audit.apply_retention(log, config, NOW, Rules.reference())
    assert rows(kept, "id") == [(1,), (2,), (4,)]
    assert rows(audit.apply_retention(log, config, NOW, Rules.from_mapping({"audit_retention_days": 30})), "id") == [(1,), (2,)]


def test_audit_statistics(log, rows):
    assert rows(audit.audit_growth(log, NOW), "total_audit_records", "last_hour_records", "last_day_records") == [(4, 1, 2)]
    assert rows(audit.audit_activity(log, NOW)) == [("a", 2, 1, 1, 0)]
    # the third change is an hour older than seven days
    assert rows(audit.daily_change_volume(log, NOW)) == [(date(2024, 1, 31), 2, 0, 1, 1, 0)]


LOG = "event_id bigint, logged_at timestamp_ntz, user_id bigint, pattern string, duration decimal(18,2), rows_examined bigint, is_error boolean, text string"


@pytest.fixture
def events(spark):
    at = datetime(2024, 1, 31, 11, 30)
    return spark.createDataFrame(
        [
            (1, at, 1, "p", D("5"), 10, False, "long text"),
            (2, at, 1, "p", D("7"), 20, True, "t"),
            (3, at, 2, "q", D("7"), 0, False, "t"),
            (4, datetime(2024, 1, 31, 10), 2, "idle", D("99"), 0, False, "t"),
        ],
        LOG,
    )


def test_event_reports(events, rows):
    assert [r.event_id for r in monitoring.slowest_events(events, NOW, 2).collect()] == [2, 3]
    digest = monitoring.pattern_digest(events, 6.0).collect()
    assert [(r.pattern, r.exec_count, r.avg_exec_time) for r in digest] == [("idle", 1, 99.0), ("q", 1, 7.0)]
    assert rows(monitoring.log_quality(events, 5)) == [(4, 3, 1, 29.5, 25.0, 75.0)]
    assert rows(monitoring.log_quality(events.limit(0), 5)) == [(0, 0, 0, 0.0, 0.0, 0.0)]
    assert rows(monitoring.usage_by_user(events, "idle")) == [(1, 2, 2, 6.0, D("7.00")), (2, 2, 1, 53.0, D("99.00"))]


def test_selectivity_sketch_is_close(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS seven", "cast(null as int) AS nothing")
    exact = {r.column_name: r for r in monitoring.column_selectivity("t", df, exact=True).collect()}
    close = {r.column_name: r for r in monitoring.column_selectivity("t", df).collect()}
    assert [exact[c].cardinality for c in ("id", "seven", "nothing")] == [5000, 7, 0]
    assert exact["nothing"].selectivity_level == "No selectivity"
    assert abs(close["id"].cardinality - 5000) < 500 and close["seven"].cardinality == 7


def test_exact_selectivity_counts_values_by_their_type(spark):
    df = spark.sql(
        """SELECT cast(id % 5 AS int) AS few, id AS many, cast(id % 9 AS decimal(18,2)) / 2 AS money,
          if(id % 3 = 0, null, id % 2 = 0) AS flag, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 6) AS at,
          concat('x', id % 4) AS name, cast(id % 2 AS double) AS real, array(id % 8) AS list, null AS nothing,
          id % 7 AS `a.b` FROM range(1000)"""
    )
    found = monitoring.column_selectivity("t", df, exact=True)
    counts = {r.column_name: r.cardinality for r in found.collect()}
    expected = {"few": 5, "many": 1000, "money": 9, "flag": 2, "at": 6, "name": 4, "real": 2, "list": 8, "nothing": 0, "a.b": 7}
    assert counts == expected
    assert monitoring.column_selectivity("t", df.limit(0), exact=True).count() == 0
    typed = monitoring.column_selectivity("t", df.select("many", "money", "flag", "at"), exact=True)
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan  # a number turned into text costs more than to count it


def test_table_sizes_match_the_files(spark, tmp_path):
    for name, n in (("big", 50_000), ("small", 10)):
        spark.range(n).repartition(2).write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("small", "big")}
    big, small = monitoring.table_sizes(tables).collect()
    size = sum(f.stat().st_size for f in (tmp_path / "big").glob("*.parquet"))
    assert (big.table_name, big.table_rows, big.files) == ("big", 50_000, 2)
    assert big.total_size_mb == pytest.approx(round(size / 1024 / 1024, 2))
    assert small.table_rows == 10
    assert monitoring.table_sizes(tables, k=1).count() == 1


def test_health(spark, events, log, rows):
    summary = spark.createDataFrame([(datetime(2024, 1, 31),), (datetime(2024, 1, 30),)], "last_calculated_at timestamp_ntz")
    fresh = monitoring.freshness(summary, NOW)
    assert fresh.first().stale_summaries == 1
    checks = monitoring.health_checks(
        monitoring.log_quality(events, 5), audit.audit_growth(log, NOW), fresh, quality.row_counts({"t": summary})
    )
    sizes = spark.createDataFrame([("a", 9_000.5), ("b", 1_001.0)], "table_name string, total_size_mb double")
    sized = monitoring.health_checks(
        monitoring.log_quality(events, 5), audit.audit_growth(log, NOW), fresh, quality.row_counts({"t": summary}), sizes
    )
    assert rows(sized.where("component = 'database_size'")) == [("database_size", "warning", 10_001)]
    assert rows(monitoring.health_rollup(checks)) == [
        ("audit_log", "healthy", 1),
        ("database", "healthy", 2),
        ("overall", "critical", 2),
        ("query_performance", "critical", 4),
        ("summary_freshness", "warning", 1),
    ]


@pytest.mark.parametrize(
    ("errors", "slow", "status"),
    [(0, 0, "healthy"), (1, 0, "healthy"), (1.1, 0, "warning"), (5.1, 0, "critical"), (0, 10.1, "warning"), (9, 11, "warning"), (0, 25.1, "critical")],
)
def test_slow_rate_is_judged_last(spark, errors, slow, status):
    df = spark.createDataFrame([(float(errors), float(slow))], "error_rate double, slow_query_rate double")
    assert df.select(monitoring.query_performance_status()).first()[0] == status


def test_a_failed_check_is_critical(spark, rows):
    checks = spark.createDataFrame([("a", "healthy", 1), ("b", "failed", 0), ("c", "unknown", 0)], "component string, status string, test_result bigint")
    assert rows(monitoring.health_rollup(checks).where("component = 'overall'")) == [("overall", "critical", 1)]
