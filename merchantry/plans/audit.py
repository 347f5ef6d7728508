"""Change capture, the audit trail, retention and audit activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.documents import merge_patch, row_image, without_members
from merchantry.functions.scalar import Moment, before, moment, within_last
from merchantry.operators.joins import small_side
from merchantry.operators.ordering import top_k
from merchantry.rules import Rules

OPERATIONS = ["INSERT", "UPDATE", "DELETE"]


def stamped(context: Mapping[str, str | None] | None = None) -> dict[str, Column]:
    """Who made the change. Missing entries fall back to the session user and fixed defaults."""
    given = dict(context or {})

    def entry(name: str, default: Column) -> Column:
        return F.coalesce(F.lit(given.get(name)).cast("string"), default)

    return {
        "changed_by": entry("user", F.current_user()),
        "session_id": entry("session_id", F.lit(None).cast("string")),
        "application_name": entry("application", F.lit("Spark-Direct")),
        "ip_address": entry("ip_address", F.lit("unknown")),
        "user_agent": entry("user_agent", F.lit(None).cast("string")),
    }


def capture_changes(
    old: DataFrame,
    new: DataFrame,
    key: str,
    table: str,
    as_of: Moment,
    context: Mapping[str, str | None] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Audit rows for the difference of two snapshots, with a JSON image of either side.

    Columns of either side count; where a side lacks one, its rows have NULL there, so an
    added or dropped column with values is a change of every row that has one. Excluded
    columns neither count nor appear in an image. Both snapshots hold each key once. An update that changed nothing leaves no trace in a snapshot, so unlike
    a trigger this logs none.
    """
    kinds = {**dict(old.dtypes), **dict(new.dtypes)}
    columns = [c for c in kinds if c not in exclude]

    def row_of(df: DataFrame) -> Column:
        given = [F.col(c) if c in df.columns else F.lit(None) for c in columns]
        return F.struct(*[v.cast(kinds[c]).alias(c) for v, c in zip(given, columns, strict=True)])

    before_row = old.select(row_of(old).alias("_old"), F.col(key).alias("_old_key"))
    after_row = new.select(row_of(new).alias("_new"), F.col(key).alias("_new_key"))
    joined = before_row.join(after_row, F.col("_old_key") == F.col("_new_key"), "full_outer")
    operation = (
        F.when(F.col("_old_key").isNull(), "INSERT")
        .when(F.col("_new_key").isNull(), "DELETE")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE")
    )

    def image(side: str) -> Column:
        members = row_image([F.col(side)[c].alias(c) for c in columns])
        return F.when(F.col(f"{side}_key").isNotNull(), members)

    changed = joined.withColumn("operation", operation).where(F.col("operation").isNotNull())
    return changed.select(
        F.lit(table).alias("table_name"),
        "operation",
        F.coalesce("_new_key", "_old_key").cast("string").alias("record_id"),
        image("_old").alias("old_values"),
        image("_new").alias("new_values"),
        moment(as_of).alias("changed_at"),
        *[c.alias(name) for name, c in stamped(context).items()],
    )


def apply_audit_config(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes that the per-table switches let through, without the excluded members.

    Tables without an entry are logged in full. The switches are one row per table; while
    they are few they are broadcast, as a join on table names would put all rows of a busy
    table into one task.
    """
    switches = config.select(
        F.col("table_name").alias("_table"),
        F.coalesce("is_enabled", F.lit(True)).alias("_on"),
        F.coalesce("audit_inserts", F.lit(True)).alias("_INSERT"),
        F.coalesce("audit_updates", F.lit(True)).alias("_UPDATE"),
        F.coalesce("audit_deletes", F.lit(True)).alias("_DELETE"),
        F.col("excluded_columns").alias("_excluded"),
    )
    joined = changes.join(small_side(switches), F.col("table_name") == F.col("_table"), "left")
    wanted = F.lit(True)
    for operation in OPERATIONS:
        off = (F.col("operation") == operation) & ~F.col(f"_{operation}")
        wanted = wanted & ~off
    passed = joined.where(F.col("_table").isNull() | (F.col("_on") & wanted))
    return passed.withColumns(
        {c: without_members(c, "_excluded") for c in ("old_values", "new_values")}
    ).select(*changes.columns)


def record_data() -> Column:
    """The record after the change; for an update the old image patched with the new one."""
    return (
        F.when(F.col("operation") == "INSERT", F.col("new_values"))
        .when(F.col("operation") == "DELETE", F.col("old_values"))
        .when(F.col("operation") == "UPDATE", merge_patch("old_values", "new_values"))
    )


def audit_trail(log: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    """The recent changes, newest first, each with its record image."""
    recent = log.where(within_last("changed_at", as_of, f"{rules.audit_window_days} days"))
    # sorted before the images are merged: the sort samples its input, which costs a second run of it
    newest = recent.orderBy(F.desc("changed_at"), F.desc("id"))
    return newest.select(
        "id",
        "table_name",
        "operation",
        "record_id",
        "changed_by",
        "changed_at",
        "session_id",
        "application_name",
        "ip_address",
        record_data().alias("record_data"),
    )


def apply_retention(log: DataFrame, config: DataFrame, as_of: Moment, rules: Rules) -> DataFrame:
    """Rows inside their table's retention; the default holds where none is configured."""
    limits = config.select(F.col("table_name").alias("_table"), F.col("retention_days").alias("_days"))
    joined = log.join(small_side(limits), F.col("table_name") == F.col("_table"), "left")
    days = F.coalesce(F.col("_days"), F.lit(rules.audit_retention_days))
    kept = F.col("changed_at") >= moment(as_of) - F.make_dt_interval(days=days)
    return joined.where(kept).select(*log.columns)


def audit_growth(log: DataFrame, as_of: Moment) -> DataFrame:
    """Totals, last hour, last day, oldest and newest in one row."""
    return log.agg(
        F.count("*").alias("total_audit_records"),
        F.count_if(within_last("changed_at", as_of, "1 hour")).alias("last_hour_records"),
        F.count_if(within_last("changed_at", as_of, "1 day")).alias("last_day_records"),
        F.min("changed_at").alias("oldest_record"),
        F.max("changed_at").alias("newest_record"),
    )


def _by_operation(*operations: str) -> list[Column]:
    return [F.count_if(F.col("operation") == o).alias(f"{o.lower()}s") for o in operations]


def audit_activity(log: DataFrame, as_of: Moment, k: int = 10) -> DataFrame:
    """Busiest tables of the last day by operation."""
    recent = log.where(within_last("changed_at", as_of, "1 day"))
    counts = recent.groupBy("table_name").agg(F.count("*").alias("audit_records"), *_by_operation(*OPERATIONS))
    return top_k(counts, k, F.desc("audit_records"), F.asc("table_name"))


def daily_change_volume(log: DataFrame, as_of: Moment, days: int = 7) -> DataFrame:
    """Changes per day by operation, newest day first. Reads are never logged, so their
    published column is always 0."""
    recent = log.where(F.col("changed_at") >= before(as_of, f"{days} days"))
    return (
        recent.groupBy(F.to_date("changed_at").alias("audit_date"))
        .agg(F.count("*").alias("total_operations"), *_by_operation("SELECT", *OPERATIONS))
        .orderBy(F.desc("audit_date"))
    )
