"""The most frequent values of an open-ended key, exactly, without shuffling all its values.

Every task keeps a Misra-Gries summary of a fixed number of counters over its rows. The summaries
name the candidates and bound what they have missed; a second pass counts the candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.operators.joins import same_keys, small_side
from merchantry.operators.ordering import top_k
from merchantry.sources.shared import Scratch, written

COUNTERS = 4096


def reduced(counts: pd.Series, counters: int) -> tuple[pd.Series, int]:
    """At most `counters` counts, each lowered by the next largest one, and by how much."""
    if len(counts) <= counters:
        return counts, 0
    cut = int(counts.nlargest(counters + 1).iloc[-1])
    return (counts - cut)[counts > cut], cut


def summaries(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """A Misra-Gries summary per task: value, count, and one row with the count a value may lack.

    Columns: `value` (text), `is_bound` (true for the row of the bound) and `n`. A value occurs at
    least `n` times in the task's rows, and at most `n` plus the bound; NULL is counted exactly.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, missed, nulls = pd.Series(dtype="int64", index=pd.Index([], dtype=object)), 0, 0
        for batch in batches:
            nulls += int(batch["value"].isna().sum())
            counts = batch["value"].value_counts()
            kept, cut = reduced(counts.add(kept, fill_value=0).astype("int64"), counters)
            missed += cut
        yield pd.DataFrame({"value": kept.index.astype(object), "is_bound": False, "n": kept.to_numpy()})
        rest = [(None, False, nulls)] if nulls else []
        yield pd.DataFrame([*rest, (None, True, missed)], columns=["value", "is_bound", "n"])

    schema = "value string, is_bound boolean, n bigint"
    return df.select(F.col(key).cast("string").alias("value")).mapInPandas(summarise, schema)


def heavy_hitters(df: DataFrame, key: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """The `k` most frequent values of a key with their exact counts: `key`, `n`.

    Ties go to the first value by text; NULL is a value and comes before others. What is shuffled
    is at most `counters` rows a task, however many values the key has and however often one of
    them occurs. If the k-th count is not above what the summaries may have missed, as where all
    values are about equally rare, the summaries cannot tell the order, and all values are counted.
    Values are told apart by their text.
    """
    rows = df.select(F.col(key).cast("string").alias(key))
    order = [F.desc("n"), F.asc_nulls_first(key)]
    with Scratch(df.sparkSession, "heavy") as scratch:
        made = scratch.written(summaries(df, key, counters), "summaries")
        totals = made.where(~F.col("is_bound")).groupBy(F.col("value").alias("_value")).agg(F.sum("n").alias("_n"))
        missed = made.where("is_bound").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        totals = scratch.written(totals, "totals")
        # the k-th lower bound: a value that cannot reach it even with all that was missed is out
        least = totals.select("_n").orderBy(F.desc("_n")).limit(k).agg(F.min("_n"), F.count("*")).first()
        if missed == 0:
            found = totals.select(F.col("_value").alias(key), F.col("_n").alias("n"))
            return top_k(written(top_k(found, k, *order), "heavy"), k, *order)
        candidates = small_side(totals.where(F.col("_n") + missed >= least[0]).select("_value"))
        counted = rows.join(candidates, same_keys([key], ["_value"]), "left_semi").groupBy(key).agg(F.count("*").alias("n"))
        best = written(top_k(counted, k, *order), "heavy")
    last = best.agg(F.min("n"), F.count("*")).first()
    if last[1] == k and last[0] > missed:
        return top_k(best, k, *order)
    return top_k(rows.groupBy(key).agg(F.count("*").alias("n")), k, *order)
