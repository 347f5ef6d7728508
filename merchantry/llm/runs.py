"""Runs of repeated words in a text, found with a run-length grammar made by recompression.

A text's words become symbols. Rounds of block compression (equal neighbours become one symbol)
and pair compression (a symbol of one half of the alphabet and a following one of the other
half become one symbol) shrink it to a single symbol. Equal stretches are compressed alike
apart from their ends, so the length of the longest common extension of two positions is found
by one comparison per round on the way up and one on the way down, for arrays of queries at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.words import mixed

MIN_LENGTH = 24
MIN_EXPONENT = 3
WORDS_AT_ONCE = 250_000
GRID_AT_ONCE = 2_000_000
QUERIES_AT_ONCE = 500_000
BARRIER = 0
BLOCKS, PAIRS = 0, 1
SCHEMA = (
    "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Round(NamedTuple):
    """A level of the grammar and how it was compressed into the next one."""

    kind: int
    symbols: np.ndarray
    left: np.ndarray  # PAIRS: whether a symbol is of the half that pairs with its successor
    parent: np.ndarray  # index of the symbol of the next level that covers a symbol
    first: np.ndarray  # first symbol below each one of the next level, and the end


def _blocks(symbols: np.ndarray, fresh: int) -> tuple[Round, np.ndarray, int]:
    """Compress blocks of equal neighbours, barriers apart; each (symbol, length) gets one new symbol."""
    starts = np.flatnonzero(np.r_[True, (symbols[1:] != symbols[:-1]) | (symbols[1:] == BARRIER)])
    first = np.r_[starts, len(symbols)]
    lengths = np.diff(first)
    after = symbols[starts]
    long = np.flatnonzero(lengths > 1)
    if len(long):
        rules, names = np.unique(after[long] << np.int64(32) | lengths[long], return_inverse=True)
        after[long] = fresh + names
        fresh += len(rules)
    parent = np.repeat(np.arange(len(starts)), lengths)
    return Round(BLOCKS, symbols, np.empty(0, bool), parent, first), after, fresh


def _pairs(symbols: np.ndarray, fresh: int, number: int) -> tuple[Round, np.ndarray, int]:
    """Compress each neighbouring pair of a left and a right symbol. The halves are drawn by a
    hash of the symbol and the round; barriers belong to neither."""
    half = mixed(symbols.astype(np.uint64) + (np.uint64(number) << np.uint64(40))) & np.uint64(1)
    inner = symbols != BARRIER
    left, right = inner & (half == 0), inner & (half == 1)
    paired = np.r_[left[:-1] & right[1:], False]
    second = np.r_[False, paired[:-1]]
    starts = np.flatnonzero(~second)
    after = symbols[starts]
    heads = paired[starts]
    if heads.any():
        at = starts[heads]
        rules, names = np.unique(symbols[at] << np.int64(32) | symbols[at + 1], return_inverse=True)
        after[heads] = fresh + names
        fresh += len(rules)
    parent = np.cumsum(~second) - 1
    return Round(PAIRS, symbols, left, parent, np.r_[starts, len(symbols)]), after, fresh


def recompress(symbols: np.ndarray) -> list[Round]:
    """The levels of the grammar of texts that stand between barriers, from the words up.

    `symbols` starts and ends with a barrier. The last level has one symbol per text.
    """
    rounds: list[Round] = []
    fresh = int(symbols.max(initial=0)) + 1
    while ((symbols[1:] != BARRIER) & (symbols[:-1] != BARRIER)).any():
        step, symbols, fresh = _blocks(symbols, fresh)
        if len(symbols) < len(step.symbols):  # a level without blocks adds nothing
            rounds.append(step)
        step, symbols, fresh = _pairs(symbols, fresh, len(rounds))
        rounds.append(step)
    return rounds


def _step(level: Round, x: np.ndarray, y: np.ndarray, forward: bool, climbing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move pairs of equal symbols on by what they surely share; and whether both then stand at
    a bound of the next level with no mismatch seen."""
    equal = level.symbols[x] == level.symbols[y]
    if level.kind == BLOCKS:
        px, py = level.parent[x], level.parent[y]
        if forward:
            rest_x, rest_y = level.first[px + 1] - x, level.first[py + 1] - y
        else:
            rest_x, rest_y = x - level.first[px] + 1, y - level.first[py] + 1
        move = np.where(equal, np.minimum(rest_x, rest_y), 0)
        going = equal & (rest_x == rest_y)
    else:
        # a left symbol begins a symbol of the next level, any other ends one
        at_bound = (level.left[x] == forward) if climbing else False
        move = (equal & ~at_bound).astype(np.int64) if climbing else equal.astype(np.int64)
        going = equal
    return (x + move, y + move, going) if forward else (x - move, y - move, going)


def extensions(rounds: list[Round], x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """Number of equal symbols from positions x and y on (or back from them, both included).

    x < y stand in one text each; barriers end every extension. Queries climb the rounds while
    their symbols agree and then come down, in constant work per round.
    """
    total = len(x)
    at_x, at_y = x.astype(np.int64), y.astype(np.int64)
    stopped = np.full(total, len(rounds))
    live = np.arange(total)
    cx, cy = at_x, at_y
    for number, level in enumerate(rounds):
        cx, cy, going = _step(level, cx, cy, forward, climbing=True)
        ended = ~going
        at_x[live[ended]], at_y[live[ended]], stopped[live[ended]] = cx[ended], cy[ended], number
        live, cx, cy = live[going], cx[going], cy[going]
        if not len(live):
            break
        cx, cy = level.parent[cx], level.parent[cy]
    at_x[live], at_y[live] = cx, cy
    for number in range(int(stopped.max(initial=0)) - 1, -1, -1):
        level = rounds[number]
        down = np.flatnonzero(stopped > number)
        cx, cy = at_x[down], at_y[down]
        if forward:
            cx, cy = level.first[cx], level.first[cy]
        else:
            cx, cy = level.first[cx + 1] - 1, level.first[cy + 1] - 1
        at_x[down], at_y[down], _ = _step(level, cx, cy, forward, climbing=False)
    return at_x - x if forward else x - at_x


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points x with a period q and the next grid point's distance, for all q up to n / 3.

    A run [s, e) has w[i] = w[i + q] for i in [s, e - q), at least max(24, 3 q) - q places, so
    at two neighbouring points of any grid of step max(q, 8). The grids have n log n points.
    """
    least = MIN_LENGTH // MIN_EXPONENT
    periods = np.arange(1, n // MIN_EXPONENT + 1)
    steps = np.maximum(periods, least)
    counts = np.maximum((n - periods - 1) // steps, 0)  # both x and x + step have a partner q later
    begin = 0
    ends = np.cumsum(counts)
    while begin < len(periods):
        upto = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, upto + GRID_AT_ONCE, "right")), begin + 1)
        size = counts[begin:end]
        q, step = np.repeat(periods[begin:end], size), np.repeat(steps[begin:end], size)
        k = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        yield k * step, q, step
        begin = end


def _candidates(symbols: np.ndarray, begin: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of the grid points of a text whose words, and the next point's, recur."""
    for x, q, step in _grid(n):
        at = begin + x
        near = np.flatnonzero(symbols[at] == symbols[at + q])
        at, q, step = at[near], q[near], step[near]
        same = symbols[at + step] == symbols[at + step + q]
        yield at[same], q[same]


def find_runs(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and then period.

    `symbols` holds texts between barriers; text k has the symbols bounds[k] + 1 to bounds[k + 1] - 1.
    A stretch that shows with several periods has the same bounds for each; the smallest is its period.
    """
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    rounds: list[Round] = []

    def answer() -> None:
        if not waiting:
            return
        at, q = (np.concatenate(part) for part in zip(*waiting, strict=True))
        waiting.clear()
        if not len(at):
            return
        if not rounds:
            rounds.extend(recompress(symbols))
        end = at + q + extensions(rounds, at, at + q, forward=True)
        start = at - extensions(rounds, at - 1, at + q - 1, forward=False)
        runs = (end - start) >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
        if runs.any():
            found.append(np.unique(np.stack([start[runs], end[runs], q[runs]], axis=1), axis=0))

    size = 0
    for begin, end in zip((bounds[:-1] + 1).tolist(), bounds[1:].tolist(), strict=True):
        if end - begin < MIN_LENGTH:
            continue
        for at, q in _candidates(symbols, begin, end - begin):
            waiting.append((at, q))
            size += len(at)
            if size > QUERIES_AT_ONCE:
                answer()
                size = 0
    answer()
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, cut at space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the digest query changes them: for one id in ten the tail is made periodic."""
    n = len(words)
    if not n or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts as numbers between barriers, and the barriers' places."""
    names: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.array([len(words) for words in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(int(bounds[-1]) + 1, np.int64)
    for begin, words in zip(bounds.tolist(), texts, strict=False):
        symbols[begin + 1 : begin + 1 + len(words)] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    return symbols, bounds


def _summary(words: list[bytes], starts: list[int], ends: list[int], periods: list[int]) -> tuple:
    """The columns of SCHEMA for a text and its runs, ordered by start and period."""
    best = (None, None, None, None)
    listed = hashlib.sha256()
    kept = words
    if starts:
        top = 0
        for k in range(1, len(starts)):
            if (ends[k] - starts[k]) * periods[top] > (ends[top] - starts[top]) * periods[k]:
                top = k
        length = ends[top] - starts[top]
        best = (starts[top], length, periods[top], 1000 * length // periods[top])
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, e, q in zip(starts, ends, periods, strict=True):
            listed.update(b"%d,%d,%d\n" % (s, e - s, q))
            dropped[s + q] += 1
            dropped[e] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    return (len(words), len(starts), *best, listed.hexdigest(), collapsed)


def _portions(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Neighbouring texts of about WORDS_AT_ONCE words together; a longer one stands alone."""
    portion: list[list[bytes]] = []
    size = 0
    for words in texts:
        if portion and size + len(words) > WORDS_AT_ONCE:
            yield portion
            portion, size = [], 0
        portion.append(words)
        size += len(words)
    if portion:
        yield portion


def described(texts: list[list[bytes]]) -> list[tuple]:
    """The summary of every text."""
    out = []
    for portion in _portions(texts):
        symbols, bounds = _joined(portion)
        starts, ends, periods = find_runs(symbols, bounds)
        cuts = np.searchsorted(starts, bounds)
        for k, words in enumerate(portion):
            own = slice(cuts[k], cuts[k + 1])
            zero = int(bounds[k]) + 1
            out.append(_summary(words, (starts[own] - zero).tolist(), (ends[own] - zero).tolist(), periods[own].tolist()))
    return out


def _describer(changed: bool):
    def describe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for ids, texts in batches:
            keys = (None if i == "" else int(i) for i in ids)
            words = [with_period(words_of(t), i) if changed else words_of(t) for i, t in zip(keys, texts, strict=True)]
            found = pd.DataFrame(described(words), columns=names)
            whole = names[2:6]
            found[whole] = found[whole].astype("Int64")
            yield found

    return lean(describe)


def _summarised(changed: bool) -> Column:
    # ids travel as text: a null among whole numbers would turn them into floats
    summary = F.pandas_udf(_describer(changed), SCHEMA)
    return summary(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def periodic_runs(docs: DataFrame, changed: bool = False) -> DataFrame:
    """Per document: its words, its runs and the one with the greatest exponent, and digests.

    A run is a stretch of words of smallest period q and length of at least max(24, 3 q) that
    cannot be extended. n_words, n_runs; start, length, period and exponent_milli of the run
    with the greatest length / period (ties: smallest start, then period); runs_sha256 over
    `start,length,period` lines; collapsed_sha256 over the words that are left when every run
    keeps its first period only. With `changed` a tenth of the texts, chosen by crc32 of doc_id,
    gets a periodic tail first; a null id is never changed.

    Null and empty texts and texts without words have no run and empty digests. Long texts
    are worked on whole. Rows are judged one by one, so repeated rows and ids and further
    columns do no harm. An empty table gives no rows.
    """
    found = docs.select("doc_id", _summarised(changed).alias("found"))
    return found.select("doc_id", "found.*")


def _collapse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for portion in _portions([words_of(text) for text in texts]):
            symbols, bounds = _joined(portion)
            starts, ends, periods = find_runs(symbols, bounds)
            change = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(change, starts + periods, 1)
            np.add.at(change, ends, -1)
            covered = np.cumsum(change) > 0
            for k, words in enumerate(portion):
                text, drop = texts.iloc[len(out)], covered[bounds[k] + 1 : bounds[k + 1]]
                if drop.any():
                    kept = [words[i] for i in np.flatnonzero(~drop).tolist()]
                    text = b" ".join(kept).decode("utf-8", "surrogatepass")
                out.append(text)
        yield pd.Series(out, dtype=object)


def collapsed(docs: DataFrame) -> DataFrame:
    """All rows and columns, with every run in `text` cut to its first period.

    A text with a run comes back as its remaining words with single spaces; others are unchanged.
    """
    return docs.withColumn("text", F.pandas_udf(lean(_collapse), "string")(F.col("text")))
