"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from merchantry.sources.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links have a < b."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    smaller = edges.withColumnRenamed("b", "u").join(least, "u")
    moved = smaller.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in the links (a, b): root is the smallest node it reaches.

    Both steps of a round keep the number of links linear and pre-aggregate before they
    shuffle, so a node with very many links is no bottleneck. A round is written to the
    shared folder, which also ends its lineage. Rounds grow with the logarithm of the size
    of the largest component. Self links and repeated links are ignored; no links give an
    empty table.
    """
    edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(edges.distinct(), "links")
    before = None
    while True:
        seen = Observation()
        state = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        step = _small_star(_large_star(edges)).observe(seen, F.count("*").alias("n"), state.alias("state"))
        edges = written(step, "links")
        now = (seen.get["n"], seen.get["state"])
        if now == before:
            break
        before = now
    own = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return own.union(edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
