"""A folder that every executor can reach, for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
PARTITIONS = "spark.sql.shuffle.partitions"
ROWS_PER_TASK = 500_000


@lru_cache(maxsize=1)
def _local_base() -> tempfile.TemporaryDirectory:
    """One folder per process, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="run-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the cluster's checkpoint folder.

    Without that setting a local session gets a temporary folder; a cluster session gets an
    error, because a folder of one machine is lost with it.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = _local_base().name
    return f"{base.rstrip('/')}/merchantry/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and its lineage ends there."""
    path = path or shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions of at most ROWS_PER_TASK of so many rows; the session's number if that is enough."""
    return max(int(spark.conf.get(PARTITIONS)), -(-rows // ROWS_PER_TASK))


@contextmanager
def small_tasks(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What runs in the block shuffles into so many partitions, and adaptive execution joins none of
    any size; scans are split likewise. The session's own settings come back at the end."""
    wanted = {
        PARTITIONS: str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
        "spark.sql.files.maxPartitionBytes": "16m",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Intermediate tables below one folder of the shared storage, removed together at the end.

    What is returned out of the block must not read them any more: write it with `written`.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.path = shared_dir(spark, purpose)
        self.tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        discard(self.spark, self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The frame as a table that lives as long as the block."""
        self.tables += 1
        return written(df, name, f"{self.path}/{name}-{self.tables}")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as its object."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, location = file_system(spark, path)
    return fs.exists(location)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once nothing reads it any more."""
    fs, location = file_system(spark, path)
    fs.delete(location, True)
