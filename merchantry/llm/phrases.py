"""Collocations: frequent phrases, counted with broadcast double-array tries, and how tightly they hold.

Words are numbered once and texts are written down as arrays of numbers. For every length the
candidates are the phrases whose parts are frequent and that stand in the text. They are sent
to the tasks as a double-array trie; each task moves the states of all its text positions
through it level by level and counts the accepting states, and Spark sums the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.operators.joins import small_side
from merchantry.sources.shared import Scratch, written

LONGEST = 5
MIN_COUNT = 100
FIRST = 2000
UNKNOWN = "und"
VOCABULARY = 1_000_000  # words that are numbered in one pass
PHRASES = 500_000  # phrases of one trie
PORTION = 1 << 16  # numbers in a row
KEYS_AT_ONCE = 4_000_000
BUCKETS = 64  # at least so many, to spread the sums
LOW_BITS = 8
LOW = (1 << LOW_BITS) - 1
CUT = b"\xff"  # stands in no UTF-8 text
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", CUT * 10)
COUNTS = "kind int, key bigint, n bigint"
PACKED = "kind int, bucket int, keys binary, counts binary"
COUNTED, EXTENSION = 0, 1


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lowered, and CUT between its pieces."""
    if not text:
        return []
    return text.encode("utf-8").lower().translate(PIECES).replace(CUT, b" \xff ").split()


class Trie(NamedTuple):
    """A double-array trie over word numbers.

    The first word leads to a state by `root`. Each further word is two symbols, its low byte and
    the rest: from state s symbol c leads to base[s] + c if check of that is s. `phrase` numbers
    the accepting states.
    """

    root: np.ndarray
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray


class _Slots:
    """Slots of a double array that are handed out to sets of symbols."""

    def __init__(self, taken: int, room: int, widest: int) -> None:
        self.used = np.zeros(taken + room, bool)
        self.used[:taken] = True
        self.end, self.widest = len(self.used), widest
        self.random = np.random.default_rng(17)

    def _grow(self, room: int) -> None:
        self.end += room
        if self.end > len(self.used):
            self.used = np.r_[self.used, np.zeros(self.end, bool)]

    def _bases(self, n: int) -> np.ndarray:
        return self.random.integers(1, max(self.end - self.widest, 2), n)

    def place(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A base for every set of symbols, such that no two sets share a slot."""
        bases = np.zeros(len(starts), np.int64)
        if self.end < 4 * self.widest:
            self._grow(4 * self.widest)
        wide = np.flatnonzero(sizes > 8)
        for i in wide[np.argsort(-sizes[wide], kind="stable")].tolist():
            own = symbols[starts[i] : starts[i] + sizes[i]]
            tried = self._bases(32)
            free = ~self.used[tried[:, None] + own].any(axis=1)
            if free.any():
                bases[i] = tried[free.argmax()]
            else:
                bases[i] = self.end
                self._grow(int(own.max()) + 1)
            self.used[bases[i] + own] = True
        left = np.flatnonzero(sizes <= 8)
        while len(left):
            free_slots = self.end - int(np.count_nonzero(self.used[: self.end]))
            wanted = int(sizes[left].sum())
            if free_slots < 2 * wanted:
                self._grow(2 * wanted)
            size = sizes[left]
            owner = np.repeat(np.arange(len(left)), size)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            tried = self._bases(len(left))
            slots = tried[owner] + symbols[starts[left][owner] + inner]
            clash = self.used[slots]
            first = np.zeros(len(slots), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            bad = np.bincount(owner[clash | ~first], minlength=len(left)) > 0
            bases[left[~bad]] = tried[~bad]
            self.used[slots[~bad[owner]]] = True
            left = left[bad]
        return bases


def build_trie(words: np.ndarray) -> Trie:
    """The trie of distinct phrases of one length, a row each; their row numbers are accepted."""
    n, length = words.shape
    columns = [words[:, 0]]
    for j in range(1, length):
        columns += [words[:, j] & LOW, words[:, j] >> LOW_BITS]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    root = np.zeros(int(words.max(initial=0)) + 1, np.int32)
    new = np.r_[True, columns[0][1:] != columns[0][:-1]][:n]
    state = np.cumsum(new)  # of every row's prefix; 0 is no state
    root[columns[0]] = state
    widest = max(LOW, len(root) >> LOW_BITS) + 1
    slots = _Slots(int(state.max(initial=0)) + 1, n * 2 * length, widest)
    placed = []
    for column in columns[1:]:
        branch = new | np.r_[True, column[1:] != column[:-1]][:n]  # rows that begin a child
        parents = np.flatnonzero(new)
        row = np.flatnonzero(branch)
        starts = np.searchsorted(row, parents)
        sizes = np.diff(np.r_[starts, len(row)])
        bases = slots.place(column[row], starts, sizes)
        children = np.repeat(bases, sizes) + column[row]
        placed.append((state[parents], bases, children, np.repeat(state[parents], sizes)))
        state, new = children[np.cumsum(branch) - 1], branch
    room = slots.end + widest
    trie = Trie(root, np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32))
    for parents, bases, children, owners in placed:
        trie.base[parents] = bases
        trie.check[children] = owners
    trie.phrase[state] = order
    return trie


def matches(trie: Trie, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `ids` where a phrase of the trie begins, and its number.

    `ids` ends with as many zeros as phrases have words. All positions move on together.
    """
    begin = np.where(ids < len(trie.root), ids, 0)
    state = trie.root[begin]
    at = np.flatnonzero(state)
    state = state[at]
    for j in range(1, length):
        word = ids[at + j]
        half = trie.base[state] + (word & LOW)
        known = trie.check[half] == state
        at, word, half = at[known], word[known], half[known]
        state = trie.base[half] + np.minimum(word >> LOW_BITS, len(trie.root) >> LOW_BITS)
        known = (trie.check[state] == half) & (word < len(trie.root))
        at, state = at[known], state[known]
    return at, trie.phrase[state]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all words; a null language counts as UNKNOWN."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, Counter[bytes]] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found.setdefault(lang, Counter()).update(tokens(text))
            for lang, words in found.items():
                words.pop(CUT, None)
                spelled = np.array([w.decode("utf-8") for w in words], object)
                n = np.fromiter(words.values(), np.int64, len(words))
                yield pd.DataFrame({"lang": np.full(len(words), lang, object), "word": spelled, "n": n})

    counted = _texts(docs).mapInPandas(lean(count), "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def vocabulary(counts: DataFrame, chunks: int) -> DataFrame:
    """(lang, word, n, chunk, id) of the frequent words; ids start at 1 and are dense in a chunk's own steps."""
    chunk = F.pmod(F.xxhash64("lang", "word"), F.lit(chunks)).cast("int")
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("lang", "word"))
    numbered = counts.withColumn("chunk", chunk).withColumn("place", place)
    return numbered.withColumn("id", ((F.col("place") - 1) * chunks + F.col("chunk") + 1).cast("int")).drop("place")


def _numbers(known: Broadcast, lang: str, text: str) -> np.ndarray:
    """The words of a text by number: 0 for words that are not known and between pieces."""
    words = tokens(text)
    return np.fromiter(map(known.value.get(lang, {}).get, words, repeat(0)), np.int32, len(words))


def _first_pass(known: Broadcast, last: bool):
    """Number the words of texts; the last pass over the vocabulary joins texts to portions."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            earlier = batch["ids"] if "ids" in batch else repeat(None)
            waiting, size, rows = [], 0, []
            for lang, text, before in zip(batch["lang"], batch["text"], earlier):
                ids = _numbers(known, lang, text)
                if before is not None:
                    ids += np.frombuffer(before, np.int32)
                if not last:
                    rows.append(ids.tobytes())
                    continue
                waiting += [ids, np.zeros(1, np.int32)]
                size += len(ids) + 1
                if size > PORTION:
                    yield pd.DataFrame({"ids": [np.concatenate(waiting).tobytes()]})
                    waiting, size = [], 0
            if waiting:
                yield pd.DataFrame({"ids": [np.concatenate(waiting).tobytes()]})
            if not last:
                yield batch[["lang", "text"]].astype(object).assign(ids=pd.Series(rows, batch.index, object))

    return lean(number)


def numbered_texts(docs: DataFrame, words: DataFrame, chunks: int, scratch: Scratch) -> DataFrame:
    """One column of int32 arrays, each of whole texts with a zero after every one.

    Of a vocabulary larger than VOCABULARY each chunk takes a pass of its own, which adds its
    numbers to those of the passes before.
    """
    rows = _texts(docs)
    for chunk in range(chunks):
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, number in words.where(F.col("chunk") == chunk).select("lang", "word", "id").toPandas().itertuples(index=False):
            known.setdefault(lang, {})[word.encode("utf-8")] = number
        last = chunk == chunks - 1
        schema = "ids binary" if last else "lang string, text string, ids binary"
        sent = docs.sparkSession.sparkContext.broadcast(known)
        rows = scratch.written(rows.mapInPandas(_first_pass(sent, last), schema), "numbers")
    return rows


def _buckets(n: int, bits: int) -> int:
    """Buckets for n words or phrases: each has the keys of about 2 ** bits of them."""
    return max(BUCKETS, n >> bits)


def _packed(kind: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> pd.DataFrame:
    """Ascending keys with their numbers, a row per bucket."""
    home = (keys >> 32 if kind == EXTENSION else keys) % buckets
    order = np.argsort(home, kind="stable")
    keys, n, home = keys[order].astype(np.int64), n[order].astype(np.int32), home[order]
    cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True][: len(home) + 1]).tolist()
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    packed = [(kind, int(home[i]), keys[i:j].tobytes(), n[i:j].tobytes()) for i, j in parts]
    return pd.DataFrame(packed, columns=["kind", "bucket", "keys", "counts"])


def _summed(waiting: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """The waiting extension keys, counted and packed."""
    return _packed(EXTENSION, *np.unique(np.concatenate(waiting), return_counts=True), buckets)


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _merger(min_count: int):
    """Add up packed rows that arrive by bucket. A bucket's distinct keys are in memory, not its rows."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, keys, counts, size = None, [], [], 0

        def frequent() -> pd.DataFrame:
            key, n = _added_up(keys, counts)
            often = n >= min_count
            return pd.DataFrame({"kind": np.int32(current[0]), "key": key[often], "n": n[often]})

        for batch in batches:
            for kind, bucket, more, n in batch.itertuples(index=False):
                if current not in (None, (kind, bucket)):
                    yield frequent()
                    keys, counts, size = [], [], 0
                current = kind, bucket
                keys.append(np.frombuffer(more, np.int64))
                counts.append(np.frombuffer(n, np.int32).astype(np.int64))
                size += len(keys[-1])
                if size > KEYS_AT_ONCE:
                    key, total = _added_up(keys, counts)
                    keys, counts, size = [key], [total], 0
        if current is not None:
            yield frequent()

    return lean(merge)


def _sums(packed: DataFrame, min_count: int) -> DataFrame:
    """(kind, key, n) of the packed keys that occur `min_count` times in all tasks together."""
    dealt = packed.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInPandas(_merger(min_count), COUNTS)


def _pairs_of(ids: np.ndarray) -> np.ndarray:
    """Neighbouring known words as one key each."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return ids[at].astype(np.int64) << 32 | ids[at + 1]


def _pair_counter(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, size = [], 0
        for batch in batches:
            for row in batch["ids"]:
                keys.append(_pairs_of(np.frombuffer(row, np.int32)))
                size += len(keys[-1])
                if size > KEYS_AT_ONCE:
                    yield _summed(keys, buckets)
                    keys, size = [], 0
        if keys:
            yield _summed(keys, buckets)

    return lean(count)


def _phrase_counter(sent: Broadcast, length: int, phrases: int, buckets: int, whole: bool, extend: bool):
    """Count the phrases of a trie, and what could be phrases of one word more.

    Such a one begins with a phrase, goes on with a frequent word and, where the trie is
    `whole`, also ends with a phrase; no other can be frequent.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie: Trie = sent.value
        total = np.zeros(phrases, np.int64)
        keys, size = [], 0
        for batch in batches:
            for row in batch["ids"]:
                ids = np.r_[np.frombuffer(row, np.int32), np.zeros(length + 1, np.int32)]
                at, number = matches(trie, ids, length)
                total += np.bincount(number, minlength=phrases)
                if not extend or not len(at):
                    continue
                word = ids[at + length]
                fits = word > 0
                if whole:
                    found = np.zeros(len(ids), bool)
                    found[at] = True
                    fits &= found[at + 1]
                keys.append(number[fits].astype(np.int64) << 32 | word[fits])
                size += len(keys[-1])
                if size > KEYS_AT_ONCE:
                    yield _summed(keys, buckets)
                    keys, size = [], 0
        if keys:
            yield _summed(keys, buckets)
        present = np.flatnonzero(total)
        yield _packed(COUNTED, present, total[present], buckets)

    return lean(count)


def _halves(upper: str, lower: str) -> list[Column]:
    """The two numbers of a key."""
    low = F.col("key").bitwiseAND(F.lit((1 << 31) - 1))
    return [F.shiftright("key", 32).cast("int").alias(upper), low.cast("int").alias(lower)]


def _columns(length: int) -> list[str]:
    return [f"w{j}" for j in range(1, length + 1)]


def _counted_phrases(
    texts: DataFrame, candidates: DataFrame, length: int, limit: int, min_count: int, extend: bool, scratch: Scratch
) -> tuple[DataFrame, DataFrame | None]:
    """(key, n) of the frequent candidates, and the candidates of one word more."""
    names = _columns(length)
    chunks = max(1, -(-candidates.count() // limit))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(*names)) - 1
    chunk = F.pmod(F.xxhash64(*names), F.lit(chunks)).cast("int")
    listed = candidates.select(*names, chunk.alias("chunk")).withColumn("number", place.cast("bigint"))
    listed = scratch.written(listed, "candidates")
    counted = extended = None
    for i in range(chunks):
        own = listed.where(F.col("chunk") == i)
        chosen = own.orderBy("number").select(*names).toPandas().to_numpy(np.int64)  # about `limit` rows
        sent = texts.sparkSession.sparkContext.broadcast(build_trie(chosen.reshape(-1, length)))
        counter = _phrase_counter(sent, length, len(chosen), _buckets(len(chosen), 12), chunks == 1, extend)
        sums = scratch.written(_sums(texts.mapInPandas(counter, PACKED), min_count), "sums")
        of_phrase = sums.where(F.col("kind") == COUNTED).select(F.col("key").alias("number"), "n")
        found = own.join(small_side(of_phrase), "number").select(F.array(*names).alias("key"), "n")
        counted = found if counted is None else counted.union(found)
        if extend:
            longer = sums.where(F.col("kind") == EXTENSION).select(*_halves("number", f"w{length + 1}"))
            longer = longer.join(small_side(own), "number").select(*names, f"w{length + 1}")
            extended = longer if extended is None else extended.union(longer)
        counted = scratch.written(counted, "phrases")
        extended = scratch.written(extended, "longer") if extend else None
        sent.unpersist()
    return counted, extended


def _whole_quotient(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)) without rounding; the products have up to 38 digits."""
    wide = {c: f"cast({c} as decimal(17,0))" for c in (a, n, l, r)}
    return F.expr(f"(cast(1000 as decimal(4,0)) * {wide[a]} * {wide[n]}) div ({wide[l]} * {wide[r]})").cast("bigint")


def _scored(counted: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(key, lang, a, l, r, n, score) of the phrases that no longer one of the same count holds."""
    parts = counted.union(words.select(F.array("id").alias("key"), "n"))
    left = parts.select(F.col("key").alias("left"), F.col("n").alias("l"))
    right = parts.select(F.col("key").alias("right"), F.col("n").alias("r"))
    size = F.size("key")
    cuts = counted.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("key", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right", F.slice("key", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(left, "left").join(right, "right")
    # a phrase with an equally frequent longer one has one of a single word more
    inside = F.when((F.col("k") == size - 1) & (F.col("l") == F.col("a")), F.col("left"))
    after = F.when((F.col("k") == 1) & (F.col("r") == F.col("a")), F.col("right"))
    held = cuts.where(size > 2).select(F.explode(F.array(inside, after)).alias("key")).where("key is not null").distinct()
    langs = words.select(F.col("id").alias("first"), "lang").join(small_side(totals), "lang")
    cuts = cuts.withColumn("first", F.col("key")[0]).join(langs, "first")
    cuts = cuts.withColumn("score", _whole_quotient("a", "n", "l", "r"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("key", "lang", "a", "n").agg(lowest).join(held, "key", "left_anti")
    return best.select("key", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def _spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Replace the key by the phrase's words."""
    spelling = small_side(words.select("id", "word"))
    each = scored.select("key", F.posexplode("key").alias("at", "id")).join(spelling, "id")
    spelled = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    phrase = F.array_join(F.transform("parts", lambda part: part["word"]), " ")
    return scored.join(spelled.select("key", phrase.alias("phrase")), "key").drop("key")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    first: int = FIRST,
    phrases: int = PHRASES,
    vocabulary_chunk: int = VOCABULARY,
) -> DataFrame:
    """Per language the `first` phrases of 2 to 5 words by score: lang, rank, phrase, a, l, r, n, score.

    Texts, with A-Z lowered, are cut at `.,;:!?` and U+000A to U+000D into pieces, and those at
    space and tab into words. n counts a language's words, a, l and r the occurrences of a phrase and
    of the two parts of the cut with the lowest score, floor(1000 a n / (l r)) (ties: the
    shorter first part). Phrases occur `min_count` times at least; one that a longer phrase with
    the same count holds is dropped. Order: score and a falling, then the phrase's UTF-8 bytes.

    A null language is UNKNOWN; null and empty texts have no words. Repeated rows and ids count as
    often as they stand. An empty table, or one without a frequent phrase, gives no rows.
    `vocabulary_chunk` and `phrases` bound what is sent to the tasks at once: of more frequent words
    or candidates each chunk takes a pass of its own, with the same result.
    """
    with Scratch(docs.sparkSession, "phrases") as scratch:
        counts = scratch.written(word_counts(docs), "words")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = counts.where(F.col("n") >= min_count)
        chunks = max(1, -(-frequent.count() // vocabulary_chunk))
        words = scratch.written(vocabulary(frequent, chunks), "vocabulary")
        texts = numbered_texts(docs, words, chunks, scratch)

        pairs = _sums(texts.mapInPandas(_pair_counter(_buckets(words.count(), 8)), PACKED), min_count)
        candidates = scratch.written(pairs.select(*_halves("w1", "w2")), "longer")
        counted = None
        for length in range(2, LONGEST + 1):
            extend = length < LONGEST
            found, candidates = _counted_phrases(texts, candidates, length, phrases, min_count, extend, scratch)
            counted = found if counted is None else counted.union(found)
        scored = scratch.written(_scored(counted, words, totals), "scored")
        spelled = _spelled(scored, words)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = spelled.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
        return written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
