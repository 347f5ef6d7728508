"""Fingerprints of texts and edited texts, and uniform shards, against their definitions."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.llm import fingerprints as f
from merchantry.llm import shards as s
from merchantry.llm.words import shingle_set
from tests.llm.edge import documents, empty


def expected(rows, fraction=f.FRACTION):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = (f.sketch(t, fraction) for t in (text, edited, following))
        out.append(
            (
                doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f.to_string(own), f.to_string(changed),
                f.likeness(own, changed), f.likeness(own, after),
            )
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edited_fingerprints_equal_the_definition(spark, buckets):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = f.edited_fingerprints(df, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_successors_across_batches_and_buckets(spark):
    rows = [(i * 3, f"text {i} " + "w " * (i % 7)) for i in range(500)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = f.edited_fingerprints(documents(spark, rows), buckets=9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_one_document_and_none(spark):
    got = f.edited_fingerprints(documents(spark, [(5, "abcd")])).collect()
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(b"abab").hexdigest()]
    assert f.edited_fingerprints(empty(spark)).count() == 0
    assert f.fingerprints(empty(spark)).count() == 0


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    large, small = " ".join(words), " ".join(words[5000:7000] + [f"x{i}" for i in range(1000)])
    a, b = f.sketch(large), f.sketch(small)
    truth = len(np.intersect1d(shingle_set(large), shingle_set(small))) / len(shingle_set(small))
    assert abs(f.containment(b, a) - truth) < 0.08
    assert f.containment(a, b) < 0.1
    merged = f.merge(a, b)
    both = np.union1d(shingle_set(large), shingle_set(small))
    assert merged.tolist() == both[both < (1 << 64) // f.FRACTION].tolist()
    assert f.from_string(f.to_string(a)).tolist() == a.tolist()


def test_short_texts_keep_one_hash():
    assert len(f.sketch("one two")) == 1 and len(f.sketch(" ")) == 0
    assert f.likeness(f.sketch(None), f.sketch("")) == 1.0
    assert f.likeness(f.sketch("one"), f.sketch("")) == 0.0
    assert len(f.merge(f.sketch("one two"), f.sketch("a b c d e f g h i j k l m n o p q r s t u v w x y z"))) >= 1


@pytest.mark.parametrize("n", [1, 7, 8, 1003])
def test_shards_are_exact_and_slots_gapless(spark, n):
    df = spark.range(0, n, 1, 5).withColumn("text", F.lit("same"))
    rows = s.shuffle_into_shards(df, 8).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_order_is_scattered_and_depends_on_the_seed(spark):
    df = spark.range(0, 4000, 1, 3)
    a, b = ({r["id"]: (r["shard"], r["slot"]) for r in s.shuffle_into_shards(df, 4, seed).collect()} for seed in (1, 2))
    assert a != b
    ids = sorted(a)
    assert abs(np.corrcoef(ids, [a[i][1] for i in ids])[0, 1]) < 0.08
    first = [i for i in ids if i < 1333]  # the first source partition
    spread = np.bincount([a[i][0] for i in first], minlength=4)
    assert spread.min() > 270 and spread.max() < 400


def test_edge_rows_and_clashing_columns(spark):
    df = documents(spark)
    out = s.shuffle_into_shards(df, 3)
    assert sorted(out.columns) == sorted(df.columns)  # shard and slot are replaced
    assert out.count() == df.count()
    assert s.shuffle_into_shards(empty(spark), 8).count() == 0


def test_matrix_has_exact_sums():
    sizes = [0, 5, 100, 1, 77, 10_000]
    matrix = s.communication_matrix(sizes, 8, 3)
    assert [sum(row) for row in matrix] == sizes
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(columns) - min(columns) <= 1


@pytest.mark.parametrize("good, bad, drawn", [(10, 5, 7), (300, 900, 200), (4 * 10**9, 10**10, 10**6)])
def test_hypergeometric_draws_have_mean_and_variance(good, bad, drawn):
    rng = random.Random(9)
    draws = [s.hypergeometric(rng, good, bad, drawn) for _ in range(1500)]
    p = good / (good + bad)
    spread = (drawn * p * (1 - p) * (good + bad - drawn) / (good + bad - 1)) ** 0.5
    assert abs(statistics.mean(draws) - drawn * p) < 0.12 * spread + 1e-9
    assert 0.92 < statistics.stdev(draws) / spread < 1.08
