"""Shared lines against a count of all lines, and the minimal perfect hash by itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from merchantry.llm import lines
from tests.llm.edge import TEXTS, documents, empty


def plain(rows, min_docs, min_chars=1):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, own in split for k in {key(x) for x in own} if len(k) >= min_chars)
    out = []
    for i, own in split:
        kept = [x for x in own if seen[key(x)] < min_docs]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def digests(found):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in found), key=str)


def shared_rows(n):
    chance = np.random.default_rng(n)
    lines_ = [f"Common Line {k}" for k in range(40)] + ["", "  ", "é", "x"]
    rows = []
    for i in range(n):
        own = [lines_[k] for k in chance.integers(0, len(lines_), 6)] + [f"own line {i}", " Menu\t" if i % 2 else "menu"]
        rows.append((i, "\n".join(own)))
    return rows + [(None, "menu\nown line 3"), (5, rows[5][1]), (5, "another text\nmenu"), (n, None), (n + 1, "menu")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_perfect_hash(n):
    chance = np.random.default_rng(n)
    high, low = (chance.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    counts = chance.integers(10, 99, n)
    shard = lines.build_shard(high, low, counts)
    assert sorted(lines.slots(shard, high, low).tolist()) == list(range(n))
    assert len(shard.fingerprints) == len(shard.counts) == n
    assert (lines.documents_with(shard, high, low) == counts).all()
    assert not lines.documents_with(shard, high, low + np.uint64(1)).any()
    assert n < 5000 or shard.bits.nbytes * 8 < 4 * n


@pytest.mark.parametrize("limit", [lines.INDEX_BYTES, 1])
@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (3, 2), (1, 1), (1000, 1)])
def test_digests_equal_a_count_of_all_lines(spark, monkeypatch, limit, min_docs, min_chars):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)  # many shards; with the small limit a group each
    rows = shared_rows(60)
    got = lines.line_digests(documents(spark, rows), min_docs, min_chars, limit).collect()
    assert sorted(map(tuple, got), key=str) == digests(plain(rows, min_docs, min_chars))


@pytest.mark.parametrize("limit", [lines.INDEX_BYTES, 1])
def test_texts_without_shared_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    rows = shared_rows(40)
    df = documents(spark, rows)
    out = lines.without_shared_lines(df, limit=limit)
    assert out.dtypes == df.dtypes
    wanted = [(i, t if d or text is not None else None) for (i, _, d, t), (_, text) in zip(plain(rows, 10), rows, strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(wanted, key=str)


def test_edge_rows_and_nothing(spark):
    got = lines.line_digests(documents(spark), min_docs=2).collect()
    assert sorted(map(tuple, got), key=str) == digests(plain(TEXTS, 2))
    assert lines.line_digests(empty(spark)).count() == 0
    assert lines.without_shared_lines(empty(spark)).count() == 0


def test_a_line_of_all_documents_is_counted_once_a_document(spark):
    df = documents(spark, [(i, "same\nsame\n" + f"line {i % 9}") for i in range(9)])
    assert {r["n_dropped"] for r in lines.line_digests(df).collect()} == {0}
