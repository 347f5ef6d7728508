"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASHING = ("row", "found", "node", "bucket", "shard", "slot", "length", "kept", "score", "base", "spans", "number")
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
BIG = 9_007_199_254_740_993  # not a double

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two"),
    (7, "one two"),
    (7, "one two"),
    (8, LONG),
    (9, LONG + " more"),
    (10, "12345 +-/ %%%"),
    (11, "naïve Ünïcode 日本語 текст wide x́"),
    (None, "a document without an id"),
    (None, None),
    (BIG, "a document with a large id"),
]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """doc_id, text, lang, source, n_chars and columns with names that operators use inside."""
    chosen = TEXTS if rows is None else rows
    full = [(i, t, None, None, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in chosen]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
