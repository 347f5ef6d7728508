"""Full copies that are read back and compared, and reads of what changed since."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from merchantry.functions.scalar import Moment, moment
from merchantry.sources.shared import path_exists


@dataclass(frozen=True)
class Manifest:
    path: str
    rows: int
    checksum: int
    verified: bool


def _checksum(df: DataFrame) -> Column:
    """Order-free and sensitive to repeated rows: a sum, because an xor cancels pairs."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def export_snapshot(df: DataFrame, path: str) -> Manifest:
    """Write a copy, counting and hashing the rows on the way, then verify what was written.

    A copy that is empty or differs from what was sent is not verified.
    """
    sent = Observation()
    observed = df.observe(sent, F.count(F.lit(1)).alias("rows"), _checksum(df).alias("checksum"))
    observed.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    stored = back.agg(F.count(F.lit(1)).alias("rows"), _checksum(back).alias("checksum")).first()
    expected = sent.get
    same = stored["rows"] == expected["rows"] and stored["checksum"] == expected["checksum"]
    return Manifest(path, stored["rows"], int(stored["checksum"]), bool(same and stored["rows"] > 0))


@dataclass(frozen=True)
class Position:
    """How far an extract came: the last time, and the last key at that time."""

    time: str
    key: int


def changes_since(
    df: DataFrame, time_column: str, last: Moment | None, key_column: str | None = None, last_key: int | None = None
) -> DataFrame:
    """Rows after the stored position; everything when there is none yet.

    With a key, rows of the position's own time but with a later key are taken as well, so
    those that share a timestamp across two extracts are not skipped.
    """
    if last is None:
        return df
    later = F.col(time_column) > moment(last)
    if key_column is not None and last_key is not None:
        later = later | ((F.col(time_column) == moment(last)) & (F.col(key_column) > last_key))
    return df.where(later)


def advanced(extracted: DataFrame, time_column: str, key_column: str, last: Position | None) -> Position | None:
    """The position after an extract; an empty one leaves it where it was."""
    end = extracted.agg(F.max(F.struct(F.col(time_column).alias("t"), F.col(key_column).alias("k"))).alias("p")).first()["p"]
    return last if end is None else Position(str(end["t"]), int(end["k"]))


def store_position(spark: SparkSession, path: str, position: Position | None) -> None:
    """Append the position. Call it after the extract is written: a failure in between repeats
    rows, and never loses any."""
    if position is not None:
        row = [(position.time, position.key)]
        spark.createDataFrame(row, "time string, key bigint").coalesce(1).write.mode("append").parquet(path)


def stored_position(spark: SparkSession, path: str) -> Position | None:
    """The furthest stored position, or None before the first extract."""
    if not path_exists(spark, path):
        return None
    end = spark.read.parquet(path).agg(F.max(F.struct("time", "key")).alias("p")).first()["p"]
    return None if end is None else Position(end["time"], end["key"])


def extract_changes(df: DataFrame, time_column: str, key_column: str, out: str, position: str) -> int:
    """Append the rows since the stored position to `out` and advance it; returns their number."""
    spark = df.sparkSession
    last = stored_position(spark, position)
    rows = changes_since(df, time_column, last and last.time, key_column, last and last.key)
    seen = Observation()
    end = F.max(F.struct(F.col(time_column).cast("string").alias("t"), F.col(key_column).cast("bigint").alias("k")))
    rows.observe(seen, F.count(F.lit(1)).alias("n"), end.alias("end")).write.mode("append").parquet(out)
    if seen.get["n"]:
        store_position(spark, position, Position(seen.get["end"]["t"], seen.get["end"]["k"]))
    return seen.get["n"]
