"""What a session needs before documents go through Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from merchantry.sources.ship import ship

# documents are long rows: the default of 10,000 a batch would put tens of megabytes, several
# times over, into every worker
LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
}


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound Arrow batches unless the session already does."""
    ship(spark)
    for name, (default, limit) in LIMITS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, limit)
