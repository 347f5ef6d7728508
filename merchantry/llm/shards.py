"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.order import shuffle_partitions, totals_before
from merchantry.sources.shared import written


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among `drawn` taken without replacement, for numbers of any size.

    Inversion from the mode: chances are walked outwards on both sides until their sum
    passes a uniform draw, which takes steps in the order of the standard deviation.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log = _log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn)
    up = down = math.exp(log)
    left = rng.random() - up
    above = below = mode
    while left > 0 and (above < high or below > low):
        if above < high:
            up *= (good - above) * (drawn - above) / ((above + 1) * (bad - drawn + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > low:
            down *= below * (bad - drawn + below) / ((good - below + 1) * (drawn - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each source partition sends to each shard in a uniform shuffle.

    Row sums are the sizes, column sums differ by one at most, and the counts are drawn one
    after the other from what is left of both.
    """
    rng = random.Random(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        row, left, others = [], size, sum(room)
        for s in range(shards):
            others -= room[s]
            taken = hypergeometric(rng, room[s], others, left)
            row.append(taken)
            left -= taken
        room = [r - t for r, t in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows with a shard from 0 to `shards` - 1 and a slot, gapless from 0 in the shard.

    Every assignment with shard sizes at most one apart is equally likely, up to the quality
    of the hash that stands for the random keys.

    1. Rows are written once with the partition that read them and two random keys.
    2. The driver learns the rows of each partition and draws the communication matrix; the
       partition counts are all it holds.
    3. Inside a partition rows are ranked by the first key, and the matrix row cuts the ranks
       into shards: the local permutation.
    4. Inside a shard the second key orders the rows: the second permutation. Its hash ranges
       are buckets with counted offsets, so that a shard of any size is never sorted whole.
    Keys hash the number of the row, so repeated rows scatter like others, and a lost task
    writes the same keys again. Columns named shard or slot are replaced. An empty table gives
    no rows.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(F.struct(*names).alias("row")).withColumn("number", F.monotonically_increasing_id())
    keyed = keyed.withColumn("source", F.spark_partition_id())
    keyed = keyed.withColumn("first", F.xxhash64(F.lit(seed), "number")).withColumn(
        "second", F.xxhash64(F.lit(seed + 1), "number", F.lit("slot"))
    )
    rows = written(keyed, "shuffle")
    counts = sorted((r["source"], r["count"]) for r in rows.groupBy("source").count().collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    cuts = [
        (source, shard, sum(sent[: shard + 1]))
        for (source, _), sent in zip(counts, matrix, strict=True)
        for shard in range(shards)
        if sent[shard]
    ]
    plan = spark.createDataFrame(cuts, "source int, shard int, end bigint")
    ranges = plan.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))

    local = Window.partitionBy("source").orderBy("first", "number")
    ranked = rows.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(ranges), "source")
    shard = F.filter("ends", lambda e: e["end"] > F.col("rank"))[0]["shard"]
    dealt = ranked.select("row", "number", "second", shard.alias("shard"))

    buckets = max(1, 4 * shuffle_partitions(df) // shards)
    bucket = F.floor((F.col("second").cast("double") / 2.0**64 + 0.5) * buckets).cast("int")
    dealt = written(dealt.withColumn("bucket", F.least(bucket, F.lit(buckets - 1))), "shuffle")
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = totals_before(sizes, "bucket", "n", "before", ("shard",)).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("second", "number")
    placed = dealt.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select("row.*", "shard", (F.col("before") + F.col("at")).alias("slot"))
