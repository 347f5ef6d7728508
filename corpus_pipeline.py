"""A training corpus from the table of documents: five stages, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import decontaminate, language, neardup, packing, pii
from merchantry.llm.session import prepare
from merchantry.sources.shared import shared_dir

MIN_LANGUAGE_SCORE = 0.5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those of `und` or with a score below MIN_LANGUAGE_SCORE go.

    The model is learned from the documents of `sf_dir`. Rows are judged one by one, so null
    ids, repeated rows and further columns pass through. Null and empty texts are `und`.
    """
    prepare(spark)
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = language.predictor(spark, model)(F.col("text"))
    judged = docs.select(F.struct(*docs.columns).alias("row"), found.alias("found"))
    kept = (F.col("found.lang_pred") != language.UNKNOWN) & (F.col("found.score") >= MIN_LANGUAGE_SCORE)
    return judged.where(kept).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Documents are linked from a similarity of NEAR_PERCENT of their five-word shingles on.
    """
    prepare(spark)
    return neardup.deduplicated(docs, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of `sf_dir`."""
    prepare(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    prepare(spark)
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

# the language model, byte-pair merges and packing have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
