"""Lines that many documents share, dropped with the help of sharded minimal perfect hashes.

The distinct lines that occur in enough documents are known by 128-bit hashes. These are dealt
into shards; each shard has a minimal perfect hash that gives every line its own place in a
compact array of 64-bit fingerprints and one of document counts. Documents look their lines up
in the arrays, so lines are never joined with documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.words import mixed
from merchantry.operators.joins import small_side
from merchantry.sources.shared import Scratch, written

MIN_CHARS = 1
MIN_DOCS = 10
SHARD_KEYS = 1 << 16
INDEX_BYTES = 64 << 20
SLACK = 2  # places of a level for each line that is still without one
LEVEL = 0xD6E8FEB86659FD93
WORD = np.uint64(6)
BITS = np.uint64(63)
ONE = np.uint64(1)
SHARD = "shard int, n_keys int, level_words binary, bits binary, fingerprints binary, counts binary"
DIGEST = "n_lines bigint, n_dropped bigint, kept_sha256 string"


def line_key(line: bytes) -> bytes:
    """A line without space and U+0009 to U+000D at its ends, A-Z lowered."""
    return line.strip().lower()


def long_enough(key: bytes, chars: int) -> bool:
    """Whether a key has at least so many code points."""
    return len(key) >= chars and (chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= chars)


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text in UTF-8; null and empty texts have one empty line."""
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_hashes(lines: list[bytes], chars: int) -> list[bytes | None]:
    """The 128-bit hash of every line's key, None for one that is too short."""
    keys = map(line_key, lines)
    return [xxhash.xxh3_128_digest(key) if long_enough(key, chars) else None for key in keys]


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of 128-bit hashes."""
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Shard(NamedTuple):
    """A minimal perfect hash of some lines and what stands at their places.

    Level after level, each line still without a place is hashed to a bit; the bits that one
    line alone has hit are set, and the others go on. A line's place is the number of set
    bits before its own.
    """

    level_words: np.ndarray  # 64-bit words of bits per level
    bits: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray


def _places(high: np.ndarray, low: np.ndarray, level: int, words: int) -> np.ndarray:
    salt = np.uint64((level + 1) * LEVEL % (1 << 64))
    return mixed(high ^ mixed(low + salt)) % np.uint64(words * 64)


def _set_before(bits: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    ones = np.bitwise_count(bits).astype(np.int64)
    return np.cumsum(ones) - ones


def build_shard(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Shard:
    """The shard of distinct hashes (high, low) that occur in `counts` documents."""
    sizes, levels = [], []
    left = np.arange(len(high))
    while len(left):
        words = max(1, -(-SLACK * len(left) // 64))
        at = _places(high[left], low[left], len(sizes), words)
        alone = np.bincount(at.astype(np.int64), minlength=words * 64)[at] == 1
        bits = np.zeros(words, np.uint64)
        np.bitwise_or.at(bits, at[alone] >> WORD, ONE << (at[alone] & BITS))
        sizes.append(words)
        levels.append(bits)
        left = left[~alone]
    shard = Shard(
        np.array(sizes, np.int64),
        np.concatenate(levels) if levels else np.empty(0, np.uint64),
        np.zeros(len(high), np.uint64),
        np.zeros(len(high), np.int64),
    )
    at = slots(shard, high, low)
    shard.fingerprints[at] = low
    shard.counts[at] = counts
    return shard


def slots(shard: Shard, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place of every line of the shard; any place or -1 for other lines."""
    out = np.full(len(high), -1)
    before = _set_before(shard.bits)
    left, begin = np.arange(len(high)), 0
    for level, words in enumerate(shard.level_words.tolist()):
        at = _places(high[left], low[left], level, words)
        word = begin + (at >> WORD).astype(np.int64)
        bit = at & BITS
        hit = (shard.bits[word] >> bit) & ONE == ONE
        lower = np.bitwise_count(shard.bits[word] & ((ONE << bit) - ONE)).astype(np.int64)
        out[left[hit]] = (before[word] + lower)[hit]
        left, begin = left[~hit], begin + words
    return out


def documents_with(shard: Shard, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """In how many documents lines occur; 0 for a line that is not in the shard."""
    at = slots(shard, high, low)
    known = at >= 0
    known[known] = shard.fingerprints[at[known]] == low[known]
    out = np.zeros(len(high), np.int64)
    out[known] = shard.counts[at[known]]
    return out


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    """The top 31 bits choose the shard; they say nothing about places, which are mixed again."""
    return ((high >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def line_counts(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, docs) of the lines in at least `min_docs` documents.

    A document counts a line once. Counts are added up per Arrow batch, per task and then by
    hash, so that a line that all documents share sends one row per task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch["text"]:
                found.update({h for h in line_hashes(lines_of(text), min_chars) if h is not None})
            high, low = halves(list(found))
            number = np.fromiter(found.values(), np.int64, len(found))
            yield pd.DataFrame({"high": high.view(np.int64), "low": low.view(np.int64), "docs": number})

    found = docs.select("text").mapInPandas(lean(count), "high bigint, low bigint, docs bigint")
    return found.groupBy("high", "low").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


def line_index(counts: DataFrame, n_lines: int) -> DataFrame:
    """One row per shard with its arrays, from (high, low, docs). Shards have about SHARD_KEYS lines."""
    shards = max(1, -(-n_lines // SHARD_KEYS))
    # the same as shard_of: the sign bit is shifted in as zero
    shard = F.pmod(F.shiftrightunsigned("high", 33), F.lit(shards)).cast("int")

    def build(lines: pd.DataFrame) -> pd.DataFrame:
        made = build_shard(
            lines["high"].to_numpy().view(np.uint64), lines["low"].to_numpy().view(np.uint64), lines["docs"].to_numpy()
        )
        row = (int(lines["shard"].iloc[0]), len(lines), *[part.tobytes() for part in made])
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD.split(", ")])

    return counts.withColumn("shard", shard).groupBy("shard").applyInPandas(build, SHARD)


class LineIndex(NamedTuple):
    """Some neighbouring shards out of `shards`, small enough for every task."""

    shards: int
    first: int
    arrays: dict[int, Shard]

    def documents_with(self, digests: list[bytes | None]) -> np.ndarray:
        """In how many documents each line occurs, 0 for one that these shards do not hold."""
        out = np.zeros(len(digests), np.int64)
        asked = np.flatnonzero([d is not None for d in digests])
        if not len(asked):
            return out
        high, low = halves([digests[i] for i in asked.tolist()])
        home = shard_of(high, self.shards)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True])
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[begin:end]
            shard = self.arrays.get(int(home[own[0]]))
            if shard is not None:
                out[asked[own]] = documents_with(shard, high[own], low[own])
        return out


def _loaded(rows: DataFrame, shards: int, first: int) -> LineIndex:
    arrays = {}
    for row in rows.collect():  # no more than INDEX_BYTES by the caller's choice of shards
        parts = (np.frombuffer(row[c], t) for c, t in (
            ("level_words", np.int64), ("bits", np.uint64), ("fingerprints", np.uint64), ("counts", np.int64),
        ))
        arrays[row["shard"]] = Shard(*parts)
    return LineIndex(shards, first, arrays)


def index_groups(spark: SparkSession, index: DataFrame, n_lines: int, limit: int = INDEX_BYTES) -> Iterator[LineIndex]:
    """The index in groups of shards of about `limit` bytes, one after the other."""
    shards = max(1, -(-n_lines // SHARD_KEYS))
    each = 18 * -(-n_lines // shards) + 1024  # two arrays of eight bytes a line, and the bits
    width = max(1, limit // each)
    for first in range(0, shards, width):
        yield _loaded(index.where((F.col("shard") >= first) & (F.col("shard") < first + width)), shards, first)


def _dropped(index: LineIndex, texts: pd.Series, min_docs: int, min_chars: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The lines of every text and which of them are in too many documents; one look-up for all texts."""
    lines = [lines_of(text) for text in texts]
    digests = [h for own in lines for h in line_hashes(own, min_chars)]
    shared = index.documents_with(digests) >= max(min_docs, 1)
    begin = 0
    for own in lines:
        yield own, shared[begin : begin + len(own)]
        begin += len(own)


def _digest(lines: list[bytes], drop: np.ndarray) -> tuple:
    kept = b"\n".join([lines[i] for i in np.flatnonzero(~drop).tolist()])
    return len(lines), int(drop.sum()), hashlib.sha256(kept).hexdigest()


def _rest(lines: list[bytes], drop: np.ndarray) -> tuple:
    kept = b"\n".join([lines[i] for i in np.flatnonzero(~drop).tolist()])
    return len(lines), int(drop.sum()), kept.decode("utf-8", "surrogatepass")


def _judged(docs: DataFrame, min_docs: int, min_chars: int, limit: int, judge: Callable, schema: str) -> DataFrame:
    """The documents as `row` with `found`, the judgement of their lines and dropped ones."""
    spark = docs.sparkSession
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row.text")
    with Scratch(spark, "lines") as scratch:
        counts = scratch.written(line_counts(docs, min_docs, min_chars), "counts")
        n_lines = counts.count()
        index = scratch.written(line_index(counts, n_lines), "index")
        groups = index_groups(spark, index, n_lines, limit)
        group = next(groups)
        following = next(groups, None)
        if following is None:
            known = spark.sparkContext.broadcast(group)

            def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
                for texts in batches:
                    found = _dropped(known.value, texts, min_docs, min_chars)
                    yield pd.DataFrame([judge(*x) for x in found], columns=names)

            return rows.withColumn("found", F.pandas_udf(lean(judged), schema)(text))

        marks = None
        while group is not None:
            part = written(_marks(rows, group, min_docs, min_chars), "line-marks")
            marks = part if marks is None else marks.union(part)
            group, following = following, next(groups, None)
    # a row's marks of all groups; equal rows have equal marks, which count once
    marks = marks.groupBy("id", "hash").agg(F.flatten(F.collect_set("numbers")).alias("numbers"))

    def marked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, numbers in batches:
            found = []
            for t, gone in zip(texts, numbers, strict=True):
                lines = lines_of(t)
                drop = np.zeros(len(lines), bool)
                if gone is not None:
                    drop[gone] = True
                found.append(judge(lines, drop))
            yield pd.DataFrame(found, columns=names)

    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("hash"))
    joined = rows.join(small_side(marks), same, "left")
    return joined.select("row", F.pandas_udf(lean(marked), schema)(text, F.col("numbers")).alias("found"))


def _marks(rows: DataFrame, group: LineIndex, min_docs: int, min_chars: int) -> DataFrame:
    """(id, hash, numbers) of the rows that have lines to drop by this group of shards."""
    known = rows.sparkSession.sparkContext.broadcast(group)

    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = _dropped(known.value, texts, min_docs, min_chars)
            yield pd.Series([np.flatnonzero(drop).tolist() for _, drop in found], dtype=object)

    marked = rows.select(
        F.col("row.doc_id").alias("id"),
        F.xxhash64("row.text").alias("hash"),
        F.pandas_udf(lean(mark), "array<bigint>")(F.col("row.text")).alias("numbers"),
    )
    return marked.where(F.size("numbers") > 0)


def line_digests(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, limit: int = INDEX_BYTES
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the sha256 of the lines that stay.

    A text is cut at line feeds. A line's key is the line with space and U+0009 to U+000D taken
    off at both ends and A-Z lowered. Keys of at least `min_chars` code points that occur in at
    least `min_docs` documents lose all their lines in every document.

    Rows are documents, also those that repeat or have a null id; rows of equal id and text get
    equal results. Null and empty texts are one empty line, which stays. The index is sent to
    the tasks in groups of about `limit` bytes. One group, the usual case, is one pass over the
    documents. With more, each group marks the lines it knows in a pass of its own, and the
    marks, of documents with lines to drop only, are joined at the end. An empty table gives no rows.
    """
    found = _judged(docs, min_docs, min_chars, limit, _digest, DIGEST)
    return found.select("row.doc_id", "found.*")


def without_shared_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, limit: int = INDEX_BYTES
) -> DataFrame:
    """All rows and columns, with the lines that `line_digests` drops taken out of `text`.

    Texts that lose no line come back unchanged, null ones too.
    """
    found = _judged(docs, min_docs, min_chars, limit, _rest, "n_lines bigint, n_dropped bigint, rest string")
    text = F.when(F.col("found.n_dropped") > 0, F.col("found.rest")).otherwise(F.col("row.text"))
    columns: list[Column] = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)
