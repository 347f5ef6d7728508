"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.order import id_buckets, shuffle_partitions
from merchantry.llm.words import common, shingle_set

FRACTION = 8
DIGITS = 16


def sketch(text: str | None, fraction: int = FRACTION) -> np.ndarray:
    """The distinct shingle hashes below 2**64 / fraction, ascending.

    If none is, the smallest hash stands in, so that a text with words never looks empty;
    a merge drops such a stand-in again as soon as a hash below the threshold is there.
    """
    found = shingle_set(text)
    return found[: max(int(np.searchsorted(found, np.uint64((1 << 64) // fraction - 1), "right")), min(1, len(found)))]


def to_string(values: np.ndarray) -> str:
    """Sixteen hexadecimal digits per hash; the empty string for an empty sketch."""
    return values.astype(">u8").tobytes().hex()


def from_string(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of two documents taken together."""
    both = np.union1d(a, b)
    kept = int(np.searchsorted(both, np.uint64((1 << 64) // fraction - 1), "right"))
    return both[: max(kept, min(1, len(both)))]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the first document's shingles that the second one has; 1 for an empty first."""
    return common(a, b) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger: 0 to 1, two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return common(a, b) / min(len(a), len(b))


def fingerprints(docs: DataFrame, fraction: int = FRACTION) -> DataFrame:
    """Per document: doc_id, n_chars and fingerprint. A null text counts as an empty one."""

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([to_string(sketch(t, fraction)) for t in texts], dtype=object)

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint"), F.length(text).cast("bigint").alias("n_chars"), printed(text).alias("fingerprint")
    )


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _described(own: pd.DataFrame, following: list[str], fraction: int) -> pd.DataFrame:
    texts = own["text"].tolist()
    prints = [sketch(t, fraction) for t in texts]
    # most successors are the next row, whose sketch is known already
    known = zip(prints[1:], texts[1:], strict=True)
    after = [p if n is t else sketch(n, fraction) for (p, t), n in zip(known, following, strict=False)]
    after += [sketch(n, fraction) for n in following[len(after) :]]
    edits = [_edited(t, n) for t, n in zip(texts, following, strict=True)]
    changed = [sketch(e, fraction) for e in edits]
    return pd.DataFrame(
        {
            "doc_id": own["doc_id"].to_numpy(),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
            "fingerprint": [to_string(p) for p in prints],
            "edited_fingerprint": [to_string(p) for p in changed],
            "near_edited": [likeness(p, c) for p, c in zip(prints, changed, strict=True)],
            "near_next": [likeness(p, n) for p, n in zip(prints, after, strict=True)],
        }
    )


def _compare(fraction: int):
    """Over rows sorted by bucket, then own rows before guests: each text with its successor.

    One row is carried from batch to batch, so a bucket of any size streams through.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last own row, still without a successor
        first = ""  # the first text of the bucket
        for batch in batches:
            batch = batch.assign(text=batch["text"].fillna(""))
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            bucket, guest, text = rows["bucket"].tolist(), rows["guest"].tolist(), rows["text"].tolist()
            at, following = [], []
            end = len(rows) - 1
            for i in range(len(rows)):
                if guest[i]:
                    continue
                if (i > 0 or held is None) and (i == 0 or bucket[i] != bucket[i - 1]):
                    first = text[i]
                if i == end:
                    break
                at.append(i)
                following.append(text[i + 1] if bucket[i + 1] == bucket[i] else first)
            held = None if guest[end] else rows.iloc[[end]]
            if at:
                yield _described(rows.iloc[at], following, fraction)
        if held is not None:
            yield _described(held, [first], fraction)

    return lean(compare)


def edited_fingerprints(docs: DataFrame, fraction: int = FRACTION, buckets: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document in descending doc_id order; after the last comes the first.

    Documents are dealt into buckets of neighbouring ids, by default eight per shuffle
    partition. The first document of a bucket is also sent, as a guest, to the bucket before
    it, so every document meets its successor and each text is shuffled once. The driver sees
    cut points and one id per bucket.

    Null texts are empty, null ids come last. Rows with an equal id are ordered by text. A table
    with one document has that document as its own successor; an empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(docs)
    base = docs.select(F.col("doc_id").cast("bigint"), "text")
    placed = id_buckets(base, "doc_id", "bucket", buckets or 8 * partitions)
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy(F.desc("bucket")).collect()
    visits = [(r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)] if len(firsts) > 1 else []
    hosts = F.broadcast(spark.createDataFrame(visits, "first bigint, host int"))  # a row per bucket
    rows = placed.withColumn("guest", F.lit(False))
    guests = placed.join(hosts, F.col("doc_id").eqNullSafe(F.col("first")))
    rows = rows.union(guests.select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest")))
    order = ["bucket", "guest", F.desc_nulls_last("doc_id"), "text"]
    dealt = rows.repartition(partitions, "bucket").sortWithinPartitions(*order)
    # a nullable id arrives in pandas as a float, which would round large ones
    sent = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = (
        "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    found = sent.mapInPandas(_compare(fraction), schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))
