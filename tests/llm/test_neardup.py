"""Near-duplicates and components against brute force."""

import random

import numpy as np

from merchantry.llm import neardup
from merchantry.llm.graph import components
from merchantry.llm.words import shingle_set, split_words
from tests.llm.edge import BIG, documents, empty


def brute_force(rows, percent=85):
    """Component and set size per row by comparing all pairs of texts word by word."""
    def shingles(text):
        words = split_words(text)
        size = min(5, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * either:
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root(j) == root(i) and d is not None]
        component = min(ids) if ids and sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def result(df):
    return sorted((tuple(r) for r in df.drop("set_key").collect()), key=repr)


def edited_copies(seed, groups, copies, edits):
    """Texts of invented words, each with copies in which some words are replaced."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force_on_edited_copies(spark):
    rows = edited_copies(1, groups=25, copies=12, edits=6)
    assert result(neardup.near_duplicates(documents(spark, rows))) == sorted(brute_force(rows), key=repr)


def test_short_sets_share_a_band():
    """6 against 7 shingles: the bands over half of the registers missed 1.8 percent of such pairs."""
    rng = np.random.default_rng(4)
    sets = rng.integers(0, 1 << 64, (4000, 7), dtype=np.uint64)
    a, b = (
        neardup.banded_registers(np.stack([neardup.registers(s[:n]) for s in sets])).reshape(-1, neardup.BANDS, neardup.ROWS)
        for n in (6, 7)
    )
    assert ((a == b).all(axis=2) & (a != neardup.EMPTY).any(axis=2)).any(axis=1).all()


def test_short_texts_equal_brute_force(spark):
    rows = []
    for i in range(400):
        text = " ".join(f"w{i}x{k}" for k in range(10))
        rows += [(2 * i, text), (2 * i + 1, f"{text} more")]
    assert result(neardup.near_duplicates(documents(spark, rows))) == sorted(brute_force(rows), key=repr)


def test_a_dense_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = edited_copies(2, groups=1, copies=150, edits=5)
    assert result(neardup.near_duplicates(documents(spark, rows))) == sorted(brute_force(rows), key=repr)


def test_edge_rows(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = neardup.near_duplicates(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept", "set_key"]
    assert result(found) == sorted(brute_force(rows), key=repr)


def test_empty_table(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.deduplicated(empty(spark)).count() == 0


def test_deduplicated_keeps_one_of_each_group_and_every_column(spark):
    df = documents(spark)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, 5, 6, 8, 10, 11, BIG, None, None], key=repr)


def test_deduplicated_tells_texts_of_one_id_apart(spark):
    text = "alpha beta gamma delta epsilon zeta"
    rows = [(1, text), (2, text), (2, "quite another text of several words"), (2, "quite another text of several words")]
    kept = sorted(r["text"] for r in neardup.deduplicated(documents(spark, rows)).collect())
    assert kept == [text, "quite another text of several words"]


def test_estimate_corrects_chance_and_meets_the_truth():
    rng = np.random.default_rng(5)
    errors = []
    for share in (0.0, 0.3, 0.85):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
            n = int(2000 * share / (1 + share) * 2)
            a, b = np.unique(pool[:2000]), np.unique(np.r_[pool[: n], pool[2000 : 4000 - n]])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sides = [neardup.registers(x)[None, :] for x in (a, b)]
            sizes = [neardup.octaves(np.array([float(len(x))])) for x in (a, b)]
            errors.append(neardup.estimate(*sides, *sizes)[0][0] - truth)
    assert abs(np.mean(errors)) < 0.01
    assert np.abs(errors).max() < 0.12


def test_registers_of_a_union_are_the_smaller_of_both():
    a, b = shingle_set("a b c d e f g h i"), shingle_set("x y z a b c d e f q r s")
    # more leading zeros and a smaller mantissa both mean a smaller value
    def rank(r):
        return np.where(r == neardup.EMPTY, 1 << 20, ((63 - (r >> 10).astype(int)) << 10) + (r & 1023))

    merged = np.minimum(rank(neardup.registers(a)), rank(neardup.registers(b)))
    assert (merged == rank(neardup.registers(np.union1d(a, b)))).all()


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (901, 900), (900, 901)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}, 900: 900, 901: 900}
    assert components(links.where("false")).count() == 0
