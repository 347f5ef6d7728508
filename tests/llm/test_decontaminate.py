"""Benchmark passages in texts: whole, edited, and close calls."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from merchantry.llm import decontaminate as d
from tests.llm.edge import documents, empty

RNG = random.Random(3)
VOCABULARY = [f"v{i}" for i in range(3000)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(words(n))) for i, n in enumerate([1, 3, 4, 5, 7, 8, 11, 14, 20, 33, 59, 120, 700])]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def planted():
    rows, wanted = [], set()
    for i, text in ITEMS:
        for before, after in ((0, 0), (57, 31), (400, 3)):
            doc_id = len(rows)
            rows.append((doc_id, " ".join([*words(before), text.upper() + "!", *words(after)])))
            wanted.add((doc_id, i))
    return rows, wanted


@pytest.mark.parametrize("chunk_windows", [500_000, 150])
def test_whole_passages_are_found_at_any_place(spark, chunk_windows):
    rows, wanted = planted()
    clean = [(1000 + i, " ".join(f"c{RNG.randrange(5000)}" for _ in range(300))) for i in range(40)]
    found = pairs(d.contaminated(documents(spark, rows + clean), benchmark(spark), chunk_windows))
    assert wanted <= found
    text = dict(rows)
    extra = {(doc, i) for doc, i in found - wanted if dict(ITEMS)[i] not in text[doc].lower()}
    assert not extra and not {doc for doc, _ in found if doc >= 1000}


def test_edited_passages(spark):
    """One changed word near an end keeps more than 0.8 of the shingles; a half passage does not."""
    item = words(60)
    near, half = ["other", *item[1:]], item[:30]
    rows = [(1, " ".join([*words(50), *near, *words(20)])), (2, " ".join([*words(50), *half, *words(60)]))]
    found = d.contaminated(documents(spark, rows), benchmark(spark, [(9, " ".join(item))])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 9)]
    assert 0.8 <= found[0]["similarity"] < 1


def test_long_texts_are_searched_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(d, "SEGMENT", 256)
    item = words(59)
    rows = [(i, " ".join([*words(190 + 10 * i), *item, *words(7)])) for i in range(12)]
    assert pairs(d.contaminated(documents(spark, rows), benchmark(spark, [(5, " ".join(item))]))) == {(i, 5) for i in range(12)}


def edited(rng, item, edits):
    """The item after so many replaced, dropped or inserted words or runs at random places."""
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1, 1, 1])] = [f"e{rng.randrange(9999)}" for _ in range(rng.choice([0, 1, 1, 1, 8]))]
    return out


def brute_similarity(text, item, weights):
    """Best share of the item's shingle weight in any run of at most twice its words (or four more)."""
    width = min(5, len(item))
    span = max(2 * len(item), len(item) + 4)
    own = {tuple(item[i : i + width]) for i in range(len(item) - width + 1)}
    there = [tuple(text[i : i + width]) for i in range(len(text) - width + 1)]
    total = sum(weights[s] for s in own)
    held = span - width + 1
    return max(
        (sum(weights[s] for s in own & set(there[i : i + held])) / total for i, s in enumerate(there) if s in own), default=0.0
    )


def edited_texts(rng):
    """Items, texts with an edited one each, and the pairs that reach 0.8."""
    opening = words(6)
    items = [[*opening, *words(n - 6)] if n % 3 == 0 else words(n) for n in (15, 18, 20, 25, 30, 36, 40, 48, 60, 63, 100)]
    counts = {}
    for item in items:
        for s in {tuple(item[i : i + 5]) for i in range(len(item) - 4)}:
            counts[s] = counts.get(s, 0) + 1
    weights = {s: 1 / n for s, n in counts.items()}
    rows, wanted = [], {}
    for _ in range(25):
        for item in items:
            text = [*words(rng.randrange(60)), *edited(rng, item, rng.randint(1, 4)), *words(rng.randrange(60))]
            rows.append((len(rows), " ".join(text)))
            for i, other in enumerate(items):
                if (share := brute_similarity(text, other, weights)) >= 0.8:
                    wanted[rows[-1][0], i] = share
    return [(i, " ".join(item)) for i, item in enumerate(items)], rows, wanted


def test_edits_at_random_places_equal_brute_force(spark):
    items, rows, wanted = edited_texts(random.Random(8))
    listed = benchmark(spark, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in d.contaminated(documents(spark, rows), listed).collect()}
    assert len(wanted) > 80
    assert found == pytest.approx(wanted)


def test_recall_of_simhash_alone(spark):
    """Without the look-up of rare shingles, over random edits in items of all lengths."""
    items, rows, wanted = edited_texts(random.Random(9))
    found = pairs(d.contaminated(documents(spark, rows), benchmark(spark, items), complete=False))
    assert found <= wanted.keys() and len(found) >= 0.98 * len(wanted) > 80


def test_passage_start_is_where_the_item_begins(spark):
    item = words(30)
    text = [*words(17), *item[:12], "inserted", "run", "of", "words", *item[12:], *words(9)]
    found = d.contaminated(documents(spark, [(1, " ".join(text))]), benchmark(spark, [(9, " ".join(item))])).collect()
    assert [(r["start_word"], r["n_words"]) for r in found] == [(17, 30)]


@given(st.integers(1, 5000))
def test_windows_fit_into_the_unedited_run_of_a_passage(n):
    lost = (n - 4) // 5 if n > 5 else 0
    # an edit at an end takes a shingle per word, one inside takes four at least
    clean = n - lost if lost < 4 else -(-(n - lost // 4) // (lost // 4 + 1))
    w, stride = d.window_size(n), d.stride_of(n)
    assert w == min(n, 2 * stride) and min(w + stride - 1, n) <= clean


def test_stepped_windows_equal_single_ones():
    hashes = np.random.default_rng(4).integers(0, 1 << 63, 203, dtype=np.uint64)
    for size, stride in ((1, 1), (2, 1), (4, 2), (6, 3), (8, 4)):
        assert (d.stepped_simhashes(hashes, size, stride) == d.simhashes(hashes, size)[::stride]).all()
        assert len(d.stepped_simhashes(hashes[: size - 1], size, stride)) == 0


def test_blocks_find_all_prints_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = d.Index(prints, np.arange(300), np.zeros(300, int))
    flipped = prints.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 6, replace=False):
            flipped[i] ^= np.uint64(1) << np.uint64(bit)
    window, entry = index.near(flipped)
    assert {(i, i) for i in range(300) if i % 6 <= d.RADIUS} <= set(zip(window.tolist(), entry.tolist(), strict=True))
    assert all(np.bitwise_count(flipped[w] ^ prints[e]) <= d.RADIUS for w, e in zip(window, entry, strict=True))


def test_edge_rows_and_nothing(spark):
    df = documents(spark)
    items = benchmark(spark, [(1, "one two"), (2, None), (3, ""), (None, "a document without an id"), (4, "%%% !!")])
    assert pairs(d.contaminated(df, items)) == {(6, 1), (7, 1), (None, None)}
    assert d.contaminated(empty(spark), items).count() == 0
    assert d.contaminated(df, benchmark(spark, [])).count() == 0
    kept = d.decontaminated(df, items)
    assert kept.dtypes == df.dtypes
    gone = [(6, "one two"), *[(7, "one two")] * 2, (None, "a document without an id")]
    left = sorted([(r["doc_id"], r["text"]) for r in kept.collect()] + gone, key=str)
    assert left == sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)
    assert d.decontaminated(df, benchmark(spark, [])).count() == df.count()


def test_a_clean_text_stays_if_its_id_is_repeated_with_a_leak(spark):
    item = words(30)
    rows = [(1, " ".join(item)), (1, "a clean text under the same id"), (2, " ".join(item)), (3, None)]
    kept = d.decontaminated(documents(spark, rows), benchmark(spark, [(9, " ".join(item))])).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, "a clean text under the same id"), (3, "")]
