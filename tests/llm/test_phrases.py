"""Collocations against counts of all word sequences, and the trie against a dictionary."""

import re
from collections import Counter

import numpy as np
import pytest

from merchantry.llm import phrases
from tests.llm.edge import documents, empty

NAMES = "doc_id bigint, text string, lang string, word string, chunk int, key string, n bigint"


def plain(rows, min_count, first):
    found, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    found[lang, tuple(words[i : i + m])] = found.get((lang, tuple(words[i : i + m])), 0) + 1
    often = {p: c for p, c in found.items() if c >= min_count}
    held = {(lang, p[i:j]) for (lang, p), c in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and found[lang, p[i:j]] == c}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or (lang, p) in held:
            continue
        cuts = [(1000 * a * totals[lang] // (l * r), k, l, r) for k in range(1, len(p))
                for l, r in [(found[lang, p[:k]], found[lang, p[k:]])]]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, k + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, own in out.items()
        for k, (s, a, p, l, r) in enumerate(sorted(own)[:first])
    )


def made_up(n):
    chance = np.random.default_rng(n)
    words = [f"w{k}" for k in range(12)] + ["Été", "\x1cx", "a|b"]
    rows = []
    for i in range(n):
        own = [words[min(int(k), len(words) - 1)] for k in chance.geometric(0.25, 40)]
        cuts = chance.choice([" ", " ", " ", "\t ", ", ", ".", "\n"], 40)
        rows.append((i, "".join(w + c for w, c in zip(own, cuts, strict=True)), ["en", "de", None, "und"][i % 7 % 4]))
    passage = "to be or not To be that is"
    rows += [(n + i, f"{passage}, w1 {passage}", "en") for i in range(30)]
    return rows + [(None, None, "en"), (1, "", None), (2, " . ", "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 7) for r in rows], NAMES)


@pytest.mark.parametrize(("width", "kinds", "n"), [(2, 5, 20), (3, 300, 3000), (5, 40, 5000), (2, 70_000, 20_000), (2, 9, 0)])
def test_trie_equals_a_dictionary(width, kinds, n):
    chance = np.random.default_rng(n)
    known = np.unique((chance.zipf(1.2, (n, width)) % kinds) + 1, axis=0).reshape(-1, width)
    chance.shuffle(known)
    trie = phrases.build_trie(known)
    text = np.r_[chance.zipf(1.2, 20_000) % (kinds + 40), known[: 2000].reshape(-1), np.zeros(width + 1, int)].astype(np.int32)
    number = {tuple(p): i for i, p in enumerate(known.tolist())}
    plain_ = [(i, number[tuple(p)]) for i in range(len(text) - width) if tuple(p := text[i : i + width].tolist()) in number]
    at, found = phrases.matches(trie, text, width)
    assert list(zip(at.tolist(), found.tolist(), strict=True)) == plain_


@pytest.mark.parametrize(
    ("min_count", "first", "bounds"), [(5, 2000, {}), (25, 6, {}), (30, 2000, {"phrases": 20, "vocabulary_chunk": 9})]
)
def test_collocations_equal_brute_force(spark, rows, min_count, first, bounds):
    data = made_up(80)
    got = phrases.collocations(frame(spark, data), min_count, first, **bounds)
    wanted = plain(data, min_count, first)
    assert rows(got) == wanted and len(wanted) > 10


def test_products_beyond_64_bits_are_exact(spark):
    big = 99_999_999_999_999
    df = spark.createDataFrame([(big, big, big - 1, big - 2)], "a bigint, n bigint, l bigint, r bigint")
    assert df.select(phrases._whole_quotient("a", "n", "l", "r")).first()[0] == 1000 * big * big // ((big - 1) * (big - 2))


def test_edge_rows_and_nothing(spark):
    got = phrases.collocations(documents(spark), min_count=2).collect()
    assert {r["lang"] for r in got} == {"und"}
    assert "quick brown fox jumps over" in {r["phrase"] for r in got}
    assert phrases.collocations(empty(spark)).count() == 0
    assert phrases.collocations(documents(spark), min_count=10**6).count() == 0
