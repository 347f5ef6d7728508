"""Benchmark decontamination: SimHash of short windows of the items leads to them, verified by weighted shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.words import SHINGLE, folded
from merchantry.operators.joins import small_side
from merchantry.sources.shared import written

RADIUS = 3
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS
SIMILARITY = 0.8
CHUNK_WINDOWS = 500_000
CHUNK_CHARS = 1_000_000
SEGMENT = 1 << 14
_WORD = re.compile(r"\w+")
STRIDES = [(12, 4), (8, 3), (5, 2), (1, 1)]  # from so many words of an item on, windows are so far apart


def hashed_words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words, marks left out, so that layout and case do not matter."""
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def stride_of(n: int) -> int:
    """How far apart the windows of a text are for items of n words.

    Five-word shingles lose four at least to an edit inside an item, and SIMILARITY lets a fifth of
    them go. So a passage has an unedited run of all its words up to 8, of n less a fifth of n - 4
    up to 23, and of 12 or more beyond. It is as long as a window and all but one of a stride's
    offsets, 3 strides - 1, so a window of the text lies in it.
    """
    return next(stride for least, stride in STRIDES if n >= least)


def window_size(n: int) -> int:
    """Words in a window for items of n words: two strides, if there are so many."""
    return min(2 * stride_of(n), n)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _prints(ones: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of windows of `size` words: a bit is set where most words set it."""
    return np.packbits(2 * ones > size, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of the windows at every offset of an item."""
    bits = _bits(hashes)
    last = len(hashes) - size + 1
    return _prints(sum(bits[k : k + last] for k in range(size)), size)


def stepped_simhashes(hashes: np.ndarray, size: int, stride: int) -> np.ndarray:
    """The SimHash of the windows of a text that begin at multiples of the stride, which divides
    their size: words are counted once per stride, and a window adds up its strides."""
    steps, parts = len(hashes) // stride, size // stride
    if steps < parts:
        return np.empty(0, np.uint64)
    bits = _bits(hashes[: steps * stride])
    step = sum(bits[k::stride] for k in range(stride))
    last = steps - parts + 1
    return _prints(sum(step[k : k + last] for k in range(parts)), size)


@dataclass
class Item:
    """An item's distinct shingles in ascending order, their weights, and the word where each first stands."""

    item_id: int | None
    n_words: int
    shingles: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    @property
    def width(self) -> int:
        return min(SHINGLE, self.n_words)

    @property
    def span(self) -> int:
        """The longest passage of an item, in words: edits may add as many as the item has."""
        return max(2 * self.n_words, self.n_words + 4)

    def telling(self) -> np.ndarray:
        """The rarest shingles, of so much weight that no passage of SIMILARITY can lack them all."""
        order = np.argsort(-self.weights, kind="stable")
        before = np.cumsum(self.weights[order]) - self.weights[order]
        return self.shingles[order[before <= (1 - SIMILARITY + 1e-9) * self.weights.sum()]]

    def best(self, folds: np.ndarray) -> tuple[float, int]:
        """The largest share of the item's shingle weight in any passage of a text, given by its
        shingles, and the word where the item would begin in the shortest, then first such passage."""
        at = np.minimum(np.searchsorted(self.shingles, folds), len(self.shingles) - 1)
        places = np.flatnonzero(self.shingles[at] == folds)
        which, total = at[places], self.weights.sum()
        if self.weights[np.unique(which)].sum() < (SIMILARITY - 1e-9) * total:
            return 0.0, 0
        least, start, seen = (0.0, 0), 0, (places + self.span - self.width)
        ends = np.searchsorted(places, seen, "right")
        room = np.concatenate([[0.0], np.cumsum(self.weights[which])])  # repeats count, so never too small
        for i in np.flatnonzero(room[ends] - room[:-1] >= (SIMILARITY - 1e-9) * total).tolist():
            own, first = np.unique(which[i : ends[i]], return_index=True)
            share = 1.0 if len(own) == len(self.shingles) else float(self.weights[own].sum() / total)
            found = (share, -int(places[i + first.max()] - places[i]))
            if found > least:
                least, start = found, int(places[i] - self.offsets[which[i]])
        return least[0], max(0, start)


class Index:
    """Fingerprints of item windows of one size, by each of their blocks.

    Two fingerprints at most RADIUS bits apart agree in one of RADIUS + 1 blocks at least, so
    looking up every block misses none.
    """

    def __init__(self, prints: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        self.prints, self.items, self.offsets = prints, items, offsets
        self.tables = []
        for b in range(BLOCKS):
            key = self.keys(prints, b)
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1))
            self.tables.append((order, starts))

    @staticmethod
    def keys(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (window, entry) within RADIUS bits; a pair may repeat."""
        left, right = [], []
        for b, (order, starts) in enumerate(self.tables):
            key = self.keys(prints, b)
            n = starts[key + 1] - starts[key]
            hit = np.flatnonzero(n)
            if len(hit):
                n = n[hit]
                window = np.repeat(hit, n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                entry = order[np.repeat(starts[key[hit]], n) + within]
                close = np.bitwise_count(prints[window] ^ self.prints[entry]) <= RADIUS
                left.append(window[close])
                right.append(entry[close])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
            hashes = hashed_words(text)
            if not len(hashes):
                continue
            size = window_size(len(hashes))
            prints = simhashes(hashes, size)
            shingles, first = np.unique(folded(hashes, min(SHINGLE, len(hashes))), return_index=True)
            rows.append((item_id, len(hashes), size, prints.view(np.int64), shingles.view(np.int64), first))
        yield pd.DataFrame(rows, columns=["item_id", "n_words", "size", "prints", "shingles", "offsets"])


def describe_items(benchmark: DataFrame) -> DataFrame:
    """Per item with words: item_id, n_words, window size, fingerprints by offset, shingles with
    their weights and first places. A shingle weighs one over the number of items that have it."""
    schema = "item_id string, n_words int, size int, prints array<bigint>, shingles array<bigint>, offsets array<bigint>"
    items = benchmark.select(F.col("item_id").cast("string"), "text").mapInPandas(_described, schema)
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    pairs = F.arrays_zip(F.col("shingles").alias("shingle"), F.col("offsets").alias("offset"))
    each = items.select("row", F.explode(pairs).alias("s")).select("row", "s.shingle", "s.offset")
    weights = each.groupBy("shingle").agg((1 / F.count("*")).alias("weight"))
    weighed = each.join(weights, "shingle").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("shingle", "weight", "offset"))).alias("w")
    )
    return items.drop("shingles", "offsets").join(weighed, "row")


def _telling_shingles(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width, the telling shingles of all items in ascending order, and whose they are."""
    found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, item in enumerate(items):
        own = item.telling()
        keys, owners = found.setdefault(item.width, ([], []))
        keys.append(own)
        owners.append(np.full(len(own), i))
    tables = {}
    for width, (keys, owners) in found.items():
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        tables[width] = key[order], np.concatenate(owners)[order]
    return tables


def _sharing(folds: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's shingles in the table, with the item of each of their entries."""
    keys, owners = table
    left = np.searchsorted(keys, folds)
    hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == folds)
    left = left[hit]
    n = np.searchsorted(keys, folds[hit], "right") - left
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(hit, n), owners[np.repeat(left, n) + within]


def _searcher(shared, complete: bool):
    state: dict[str, tuple[list[Item], dict[tuple[int, int], Index], dict[int, tuple[np.ndarray, np.ndarray]]]] = {}

    def search_chunk(ids: list, texts: list) -> list[tuple]:
        items, indexes, tables = state["index"]
        own = [hashed_words(t) for t in texts]
        lengths = np.array([len(h) for h in own])
        ends = np.cumsum(lengths)
        stream = np.concatenate(own) if own else np.empty(0, np.uint64)
        candidates: set[tuple[int, int]] = set()

        def note(at: np.ndarray, width: int, item: np.ndarray) -> None:
            doc = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[doc]
            candidates.update(zip(doc[inside].tolist(), item[inside].tolist(), strict=True))

        for begin in range(0, len(stream), SEGMENT):
            for (size, stride), index in indexes.items():
                part = stream[begin : begin + SEGMENT + size - 1]
                window, entry = index.near(stepped_simhashes(part, size, stride))
                note(window * stride + begin, size, index.items[entry])
        folds = {w: folded(stream, w) if len(stream) >= w else stream[:0] for w in tables}
        for width, table in tables.items() if complete else ():
            at, item = _sharing(folds[width], table)
            note(at, width, item)
        found = []
        for doc, i in sorted(candidates):
            item = items[i]
            begin, end = ends[doc] - lengths[doc], ends[doc] - item.width + 1
            similarity, start = item.best(folds[item.width][begin : max(begin, end)])
            if similarity >= SIMILARITY:
                found.append((ids[doc], item.item_id, start, item.n_words, similarity))
        return found

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "index" not in state:
            state["index"] = _loaded(shared.value)
        columns = ["doc_id", "item_id", "start_word", "n_words", "similarity"]
        for batch in batches:
            ids, texts, size, rows = [], [], 0, []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    rows += search_chunk(ids, texts)
                    ids, texts, size = [], [], 0
            rows += search_chunk(ids, texts)
            yield pd.DataFrame(rows, columns=columns)

    return lean(search)


def _loaded(rows: list[tuple]) -> tuple[list[Item], dict[tuple[int, int], Index], dict[int, tuple[np.ndarray, np.ndarray]]]:
    items, windows = [], {}
    for i, (item_id, n_words, size, prints, shingles, weights, offsets) in enumerate(rows):
        order = np.argsort(shingles)
        items.append(Item(item_id, n_words, shingles[order], weights[order], offsets[order]))
        step = size, min(stride_of(n_words), size)
        windows.setdefault(step, []).append((prints, np.full(len(prints), i), np.arange(len(prints))))
    indexes = {s: Index(*(np.concatenate(c) for c in zip(*w, strict=True))) for s, w in windows.items()}
    return items, indexes, _telling_shingles(items)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, chunk_windows: int = CHUNK_WINDOWS, complete: bool = True
) -> DataFrame:
    """Each document and benchmark item of which it holds a passage: doc_id, item_id, start_word,
    n_words and similarity, one row per pair.

    Every window of an item, of eight words or fewer in short items, has a SimHash fingerprint, and
    so have the windows of a text that are half a window apart. Blocks of the fingerprints lead
    from these to all windows of items within RADIUS bits. The windows are so short that a
    passage with SIMILARITY of an item's shingles has an unedited one, wherever the edits are, as
    long as its shingles weigh alike. Shingles that items share weigh less; for passages that have
    lost many of these, `complete` also looks up the rarest shingles of every item, more than 0.2 of
    its weight, of which no passage lacks all. An item counts if five-word shingles with 0.8 or
    more of its weight are found in a run of at most twice its words. Words are compared without
    case or marks. Passages of any place in a text of any length are found; memory is bounded by
    segments of the text.

    The items are cut into chunks of at most about `chunk_windows` fingerprints; each chunk is
    sent to the tasks and all documents are read once per chunk, so a benchmark of any size
    has a bounded broadcast. Null texts and texts without words match nothing; items without
    words are left out, shorter ones than a shingle count whole. Null ids are returned as they
    are; repeated rows give repeated matches. An empty benchmark or table gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id string, item_id string, start_word bigint, n_words int, similarity double"
    base = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text")
    items = written(describe_items(benchmark), "items")
    total = items.agg(F.sum(F.size("prints"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_windows))
    found = None
    for chunk in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).collect()
        sent = [
            (
                r["item_id"], r["n_words"], r["size"], np.array(r["prints"], np.int64).view(np.uint64),
                np.array([w["shingle"] for w in r["w"]], np.int64).view(np.uint64), np.array([w["weight"] for w in r["w"]]),
                np.array([w["offset"] for w in r["w"]], np.int64),
            )
            for r in rows
        ]
        known = spark.sparkContext.broadcast(sent)
        part = base.mapInPandas(_searcher(known, complete), schema)
        if chunks > 1:  # one chunk is held at a time
            part = written(part, "passages")
            known.unpersist()
        found = part if found is None else found.union(part)
    ids = {c: F.col(c).cast("bigint") for c in ("doc_id", "item_id")}
    return found.withColumns(ids)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without a match. Rows are judged by id and text, so a clean text
    stays if its id is null or repeated with another one."""
    number = F.col("doc_id").cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("row"), number.alias("id"), F.xxhash64("text").alias("hash"), "text")
    # a stand-in id for each id and text
    keyed = rows.select("row", "text", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "hash").alias("doc_id"))
    found = contaminated(keyed.select("doc_id", "text"), benchmark)
    leaks = written(found.select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    # few leaks are broadcast after a count, and the documents then stay where they are
    kept = keyed.select("row", "doc_id").join(small_side(leaks), F.col("doc_id") == F.col("leaked"), "left_anti")
    return kept.select("row.*")
