"""Periodic runs against a search of all periods, and the grammar's extensions by themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from merchantry.llm import runs
from merchantry.llm.queries import QUERIES
from tests.llm.edge import LONG, documents, empty

DIRECTORY = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, end, period) of all runs, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(text, doc_id):
    words = [w for w in (text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(words):
    found = plain_runs(words)
    best = max(found, key=lambda r: ((r[1] - r[0]) * 10**9 // r[2], -r[0], -r[2]), default=None)
    figures = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *figures, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def made_up(chance):
    n = chance.choice([0, 1, 5, 24, 30, 80, 200])
    words = [b"%d" % chance.randrange(chance.choice([1, 2, 3, 8])) for _ in range(n)]
    if n > 24 and chance.random() < 0.6:
        begin, p = chance.randrange(n // 2), chance.randint(1, n // 3)
        words = [w if i < begin else words[begin + (i - begin) % p] for i, w in enumerate(words)]
        if chance.random() < 0.5:
            words[chance.randrange(n)] = b"x"
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_a_search_of_all_periods(seed):
    chance = random.Random(seed)
    texts = [made_up(chance) for _ in range(chance.randint(1, 8))]
    symbols, bounds = runs._joined(texts)
    got = list(zip(*(part.tolist() for part in runs.find_runs(symbols, bounds)), strict=True))
    zeros = (bounds + 1).tolist()
    assert got == [(s + z, e + z, q) for z, words in zip(zeros, texts, strict=False) for s, e, q in plain_runs(words)]


@pytest.mark.parametrize("alphabet", [1, 2, 5])
def test_grammar_extensions(alphabet):
    chance = np.random.default_rng(alphabet)
    words = [b"%d" % w for w in chance.integers(0, alphabet, 300)]
    symbols, _ = runs._joined([words, words[:50]])
    rounds = runs.recompress(symbols)
    assert len(rounds[-1].symbols) >= 5 and sum(len(r.symbols) for r in rounds) < 12 * len(symbols)
    x, y = np.triu_indices(120, 1)
    x, y = x + 1, y + 1
    forward, back = (runs.extensions(rounds, x, y, way) for way in (True, False))
    for a, b, f, r in list(zip(x.tolist(), y.tolist(), forward.tolist(), back.tolist(), strict=True))[::7]:
        f_plain, r_plain = 0, 0
        while symbols[a + f_plain] == symbols[b + f_plain] and symbols[a + f_plain]:
            f_plain += 1
        while symbols[a - r_plain] == symbols[b - r_plain] and symbols[a - r_plain]:
            r_plain += 1
        assert (f, r) == (f_plain, r_plain)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, DIRECTORY).collect()}
    short = [r for r in docs if len(r["text"] or "") < 8000]
    assert len(got) == len(docs) and len(short) > 100
    assert any(r[0] for r in got.values())
    for r in short:
        assert got[r["doc_id"]] == plain_row(plain_words(r["text"], r["doc_id"]))


def test_edge_rows(spark, rows):
    found = rows(runs.periodic_runs(documents(spark)), "doc_id", "n_words", "n_runs", "start")
    assert len(found) == 15 and (8, 30_000, 0, None) in found and (None, 0, 0, None) in found
    assert runs.periodic_runs(empty(spark), changed=True).count() == 0


def test_a_long_text_of_one_word_and_collapse(spark):
    text = " ".join(["la"] * 40_000)
    df = documents(spark, [(1, text), (2, "a  b\n" * 12), (3, "no  run "), (4, None), (5, LONG + " x" * 24)])
    found = {r["doc_id"]: r for r in runs.periodic_runs(df).collect()}
    assert [found[1][c] for c in ("n_runs", "start", "length", "period", "exponent_milli")] == [1, 0, 40_000, 1, 40_000_000]
    out = {r["doc_id"]: r["text"] for r in runs.collapsed(df).collect()}
    assert out == {1: "la", 2: "a b", 3: "no  run ", 4: None, 5: LONG + " x"}
    assert runs.collapsed(df).columns == df.columns


def test_ids_that_are_changed(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = documents(spark, [(i, " ".join(f"w{(k * k) % 91}" for k in range(100 + i))) for i in ids])
    for r in runs.periodic_runs(df, changed=True).drop("n_words").collect():
        text = " ".join(f"w{(k * k) % 91}" for k in range(100 + r["doc_id"]))
        assert tuple(r)[1:] == plain_row(plain_words(text, r["doc_id"]))
