"""Statistics over event logs and tables, and the health report built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.classify import selectivity_level
from merchantry.functions.scalar import Moment, mean, preview, rate_or_zero, within_last, zero_if_null
from merchantry.operators.ordering import top_k
from merchantry.plans.quality import stacked

SEVERITY = ["healthy", "warning", "critical"]


def slowest_events(log: DataFrame, as_of: Moment, k: int = 20, preview_length: int = 200) -> DataFrame:
    """The k longest events of the last hour with the start of their text."""
    recent = log.where(within_last("logged_at", as_of, "1 hour"))
    shown = recent.select(
        "event_id",
        "logged_at",
        "user_id",
        "duration",
        "rows_examined",
        "pattern",
        preview("text", preview_length).alias("text_preview"),
    )
    return top_k(shown, k, F.desc("duration"), F.asc("event_id"))


def pattern_digest(log: DataFrame, slower_than: float, k: int = 10) -> DataFrame:
    """Slow patterns: runs, mean and longest duration, rows per run, first and last seen.

    Durations keep the unit of the log; the mean is compared in that unit.
    """
    grouped = log.groupBy("pattern").agg(
        F.count("*").alias("exec_count"),
        F.sum("duration").alias("total"),
        F.count("duration").alias("timed"),
        F.max("duration").alias("max_exec_time"),
        F.sum("rows_examined").alias("examined"),
        F.min("logged_at").alias("first_seen"),
        F.max("logged_at").alias("last_seen"),
    )
    digest = grouped.select(
        "pattern",
        "exec_count",
        mean("total", "timed").alias("avg_exec_time"),
        "max_exec_time",
        mean("examined", "exec_count").alias("avg_rows_examined"),
        "first_seen",
        "last_seen",
    )
    slow = digest.where(F.col("avg_exec_time") > slower_than)
    return top_k(slow, k, F.desc("avg_exec_time"), F.asc("pattern"))


def quality_counts(slow_threshold: float) -> list[Column]:
    return [
        F.count("*").alias("total_queries"),
        F.count_if(F.col("duration") > slow_threshold).alias("slow_queries"),
        F.count_if("is_error").alias("errors"),
        zero_if_null(F.sum("duration")).alias("total_duration"),
    ]


def quality_rates() -> list[Column]:
    average = F.when(F.col("total_queries") > 0, mean("total_duration", "total_queries")).otherwise(F.lit(0.0))
    return [
        F.col("total_queries"),
        F.col("slow_queries"),
        F.col("errors"),
        average.alias("average_execution_time"),
        rate_or_zero("errors", "total_queries").alias("error_rate"),
        rate_or_zero("slow_queries", "total_queries").alias("slow_query_rate"),
    ]


def log_quality(log: DataFrame, slow_threshold: float) -> DataFrame:
    """Totals, mean duration, error and slow rates of the whole log; zeros when it is empty."""
    return log.agg(*quality_counts(slow_threshold)).select(*quality_rates())


def usage_by_user(log: DataFrame, idle_pattern: str) -> DataFrame:
    """Entries per user, those that are not idle, mean and longest duration, busiest first."""
    grouped = log.groupBy("user_id").agg(
        F.count("*").alias("connection_count"),
        F.count_if(F.col("pattern") != idle_pattern).alias("active_connections"),
        F.sum("duration").alias("total"),
        F.count("duration").alias("timed"),
        F.max("duration").alias("max_time"),
    )
    return grouped.select(
        "user_id", "connection_count", "active_connections", mean("total", "timed").alias("avg_time"), "max_time"
    ).orderBy(F.desc("connection_count"), "user_id")


def _counted_as(column: str, kind: str) -> tuple[str, str]:
    """The expression by which values of a column are told apart, and its type. Whole numbers are
    widened; types that do not group, or that compare otherwise than they read, go by their text."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return f"cast(`{column}` as bigint)", "bigint"
    if kind in ("string", "boolean", "date", "timestamp_ntz") or kind.startswith("decimal("):
        return f"`{column}`", kind
    return f"cast(`{column}` as string)", "string"


def _distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, exactly, with one read of the frame per type.

    Columns of one type become (position, value) rows, so that most keys are of fixed width and no
    value is turned into text to be counted.
    """
    by_kind: dict[str, dict[str, str]] = {}
    for name, (_, dtype) in zip(names, df.selectExpr(*[f"`{c}`" for c in names]).dtypes, strict=True):
        expression, kind = _counted_as(name, dtype)
        by_kind.setdefault(kind, {})[name] = expression
    counts = []
    for columns in by_kind.values():
        pairs = ", ".join(f"{i}, {expression}" for i, expression in enumerate(columns.values()))
        long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (_at, value)")
        values = long.groupBy("_at", "value").agg(F.lit(1).alias("_one"))
        counted = values.groupBy("_at").agg(F.count("value").alias("cardinality"))
        name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_at"))
        counts.append(counted.select(name.alias("column_name"), "cardinality"))
    return stacked(counts)


def column_selectivity(
    table: str, df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False
) -> DataFrame:
    """Distinct values per column, banded.

    The sketch reads the table once and sends one sketch per column and task. The exact
    form turns columns into (column, value) rows and counts them in two grouped steps,
    which shuffles every distinct value.
    """
    names = list(columns or df.columns)
    if exact:
        counts = _distinct_values(df, names)
    else:
        sketched = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names])
        pairs = ", ".join(f"'{c}', `{c}`" for c in names)
        counts = sketched.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, cardinality)")
    return counts.select(
        F.lit(table).alias("table_name"),
        "column_name",
        "cardinality",
        selectivity_level("cardinality").alias("selectivity_level"),
    )


def table_sizes(tables: Mapping[str, DataFrame], k: int = 20) -> DataFrame:
    """Rows, files and megabytes of file-based tables, largest first.

    Size comes from the file metadata that the scan carries, so no file list is built on
    the driver. A file without rows is not seen.
    """
    sizes = []
    for name, df in tables.items():
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("rows"), F.first("_metadata.file_size").alias("bytes")
        )
        sizes.append(
            files.agg(
                F.lit(name).alias("table_name"),
                zero_if_null(F.sum("rows")).cast("bigint").alias("table_rows"),
                F.count("*").alias("files"),
                F.round(zero_if_null(F.sum("bytes")) / 1024 / 1024, 2).alias("total_size_mb"),
            )
        )
    return top_k(stacked(sizes), k, F.desc("total_size_mb"), F.asc("table_name"))


def freshness(summary: DataFrame, as_of: Moment) -> DataFrame:
    """How old the rows of a summary table are; stale means calculated over a day ago."""
    return summary.agg(
        F.count("*").alias("total_summaries"),
        F.min("last_calculated_at").alias("oldest_calculation"),
        F.max("last_calculated_at").alias("newest_calculation"),
        F.count_if(~within_last("last_calculated_at", as_of, "1 day")).alias("stale_summaries"),
    )


def slow_patterns(log: DataFrame, limit: float) -> DataFrame:
    """How many patterns take longer than `limit` on average, as one row."""
    means = log.groupBy("pattern").agg(mean(F.sum("duration"), F.count("duration")).alias("average"))
    return means.agg(F.count_if(F.col("average") > limit).alias("slow_patterns"))


def query_performance_status() -> Column:
    """Status of error and slow rates. The slow rate is judged last and replaces the verdict
    on errors, so a slow warning also lowers an error alarm."""
    errors, slow = F.col("error_rate"), F.col("slow_query_rate")
    return (
        F.when(slow > 25.0, "critical")
        .when(slow > 10.0, "warning")
        .when(errors > 5.0, "critical")
        .when(errors > 1.0, "warning")
        .otherwise("healthy")
    )


def size_status(megabytes: Column) -> Column:
    return F.when(megabytes > 50_000, "critical").when(megabytes > 10_000, "warning").otherwise("healthy")


def health_checks(
    quality: DataFrame,
    growth: DataFrame,
    fresh: DataFrame,
    total_rows: DataFrame,
    sizes: DataFrame | None = None,
    slow_patterns: DataFrame | None = None,
) -> DataFrame:
    """One row per check with its status and the figure it was judged by.

    `sizes` adds the check of the total size over the rows of `table_sizes`, `slow_patterns`
    that of the number of slow patterns, of which fewer than ten are fine.
    """

    def check(df: DataFrame, name: str, status: Column, figure: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("component"), status.alias("status"), figure.cast("bigint").alias("test_result")
        )

    quiet = F.when(F.col("last_hour_records") == 0, "warning").otherwise("healthy")
    stale = F.when(F.col("stale_summaries") > 0, "warning").otherwise("healthy")
    filled = F.when(F.col("record_count") > 0, "healthy").otherwise("critical")
    checks = []
    if sizes is not None:
        total = sizes.agg(zero_if_null(F.sum("total_size_mb")).alias("megabytes"))
        checks.append(check(total, "database_size", size_status(F.col("megabytes")), F.col("megabytes")))
    if slow_patterns is not None:
        few = F.when(F.col("slow_patterns") < 10, "healthy").otherwise("warning")
        checks.append(check(slow_patterns, "slow_patterns", few, F.col("slow_patterns")))
    return stacked(
        [
            *checks,
            check(quality, "query_performance", query_performance_status(), F.col("total_queries")),
            check(growth, "audit_log", quiet, F.col("last_hour_records")),
            check(fresh, "summary_freshness", stale, F.col("stale_summaries")),
            check(total_rows, "database", filled, F.col("record_count")),
        ]
    )


def health_rollup(checks: DataFrame) -> DataFrame:
    """The checks and one `overall` row with the worst of them. A failed check counts as
    critical, and a status that is neither warning nor critical as healthy."""
    rank = (
        F.when(F.col("status").isin("critical", "failed"), 3).when(F.col("status") == "warning", 2).otherwise(1)
    )
    overall = checks.agg(
        F.lit("overall").alias("component"),
        F.element_at(F.lit(SEVERITY), F.coalesce(F.max(rank), F.lit(1))).alias("status"),
        F.count_if(rank > 1).alias("test_result"),
    )
    return checks.unionByName(overall)
