"""Joins: anti joins, cascades, bounded broadcasts and the parent hierarchy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from merchantry.sources.shared import discard, shared_dir, written

BROADCAST_ROWS = 100_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most `rows` rows: one partial count per task, no rows are moved."""
    return df.count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark narrow lookup rows for broadcast after counting that there are few of them.

    A larger table is returned unmarked, and the planner then joins by shuffle, with hot
    keys split by adaptive execution.
    """
    return F.broadcast(df) if few(df, rows) else df


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of key columns in which NULL equals NULL; planned as an equi join."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def never_used(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Rows of `dim` without any row in `fact`; fact keys are made distinct before the shuffle."""
    return dim.join(fact.select(key).distinct(), key, "left_anti")


def cascade_delete(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent still exists; children without a parent key stay."""
    kept = parent.select(F.col(key).alias("_key")).distinct()
    joined = child.join(kept, F.col(foreign_key) == F.col("_key"), "left")
    return joined.where(F.col("_key").isNotNull() | F.col(foreign_key).isNull()).select(*child.columns)


def set_null_on_delete(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows with the foreign key set to NULL where its parent is gone."""
    kept = parent.select(F.col(key).alias("_key")).distinct()
    joined = child.join(kept, F.col(foreign_key) == F.col("_key"), "left")
    return joined.withColumn(foreign_key, F.when(F.col("_key").isNotNull(), F.col(foreign_key))).select(
        *child.columns
    )


def resolve_key(df: DataFrame, column: str, lookup: DataFrame, by: str, key: str) -> DataFrame:
    """Replace a natural key such as a slug by the id it stands for; an unknown one gives NULL."""
    pairs = lookup.select(F.col(by).alias("_by"), F.col(key).alias(key))
    return df.join(pairs, F.col(column) == F.col("_by"), "left").drop("_by")


def hierarchy_paths(
    df: DataFrame, key: str, parent: str, label: str, separator: str = " > ", max_rounds: int = 16
) -> DataFrame:
    """Path of labels from the root to every row, and its depth, by pointer doubling.

    Each round joins every row's open ancestor to that ancestor's own path, so the covered
    depth doubles: sixteen rounds cover 65,536 levels. A row still open after them is part
    of a cycle, which raises. A parent that does not exist ends the path. Rounds are written
    down, as each one would otherwise repeat all earlier ones twice: the result is a table as
    of this call, in the shared folder, and the tables of earlier rounds are removed.
    """
    known = df.select(F.col(key).alias("_known"))
    nodes = df.join(known, F.col(parent) == F.col("_known"), "left")
    paths = nodes.select(
        F.col(key).alias("_id"),
        F.col("_known").alias("_up"),
        F.col(label).alias("_path"),
        F.lit(1).cast("bigint").alias("_depth"),
    )
    spark, done = df.sparkSession, None
    for _ in range(max_rounds + 1):
        still, path = Observation(), shared_dir(df.sparkSession, "paths")
        paths = written(paths.observe(still, F.count("_up").alias("open")), "paths", path)
        if done:
            discard(spark, done)
        done = path
        if still.get["open"] == 0:
            break
        above = paths.select(*[F.col(c).alias(f"_above{c}") for c in paths.columns])
        paths = paths.join(above, F.col("_up") == F.col("_above_id"), "left").select(
            "_id",
            F.col("_above_up").alias("_up"),
            F.when(F.col("_above_path").isNull(), F.col("_path"))
            .otherwise(F.concat("_above_path", F.lit(separator), "_path"))
            .alias("_path"),
            (F.col("_depth") + F.coalesce(F.col("_above_depth"), F.lit(0))).alias("_depth"),
        )
    else:
        raise ValueError(f"{parent} forms a cycle")
    return paths.select(F.col("_id").alias(key), F.col("_path").alias("path"), F.col("_depth").alias("depth"))


def hierarchy_paths_lazy(
    df: DataFrame, key: str, parent: str, label: str, separator: str = " > ", max_depth: int = 100
) -> DataFrame:
    """The rows of `hierarchy_paths` as one recursive plan: nothing runs before the frame is used.

    Keys are unique. For hierarchies of bounded size and depth, like categories: each level reads the rows once
    more, Spark stops a recursion at `spark.sql.cteRecursionRowLimit` rows (a million), and one
    deeper than `max_depth` raises. A row that no root leads to is part of a cycle or below one,
    which raises as well when the frame is used.
    """
    known = df.select(F.col(key).alias("_known"))
    nodes = df.join(known, F.col(parent) == F.col("_known"), "left").select(
        F.col(key).alias("id"), F.col("_known").alias("up"), F.col(label).alias("label")
    )
    found = df.sparkSession.sql(
        f"""WITH RECURSIVE paths(id, path, depth) MAX RECURSION LEVEL {max_depth + 1} AS (
          SELECT id, label, 1L FROM {{nodes}} WHERE up IS NULL
          UNION ALL
          SELECT n.id, concat(p.path, :separator, n.label), p.depth + 1 FROM {{nodes}} n JOIN paths p ON n.up = p.id)
        SELECT id AS _id, path AS _path, depth AS _depth FROM paths""",
        args={"separator": separator},
        nodes=nodes,
    )
    cycle = F.raise_error(F.lit(f"{parent} forms a cycle")).cast("bigint")
    every = df.select(F.col(key).alias("_key")).join(found, F.col("_key").eqNullSafe(F.col("_id")), "left")
    depth = F.when(F.col("_depth").isNull(), cycle).otherwise(F.col("_depth"))
    return every.select(F.col("_key").alias(key), F.col("_path").alias("path"), depth.alias("depth"))
