"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantry.llm.learning import held_out, sampled
from merchantry.llm.memory import lean
from merchantry.operators.joins import small_side
from merchantry.sources.shared import Scratch

UNKNOWN = "und"
LONGEST = 4
SMOOTHING = 0.5
EVIDENCE = 25
MEMORY = 200_000
CELLS = 4_000_000
PART = 50_000
SALTS = 32
_WORD = re.compile(r"[^\W\d_]+")
# all that the pattern above takes for a letter and Unicode counts among the numbers
_SIGNS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and _WORD.match(c) and not c.isalpha())
_BLANKS = str.maketrans(dict.fromkeys(_SIGNS, " "))


def words_of(text: str) -> list[str]:
    """The stretches of letters of a text; signs for numbers such as ½ or Ⅷ are no letters."""
    low = text.lower()
    return _WORD.findall(low if low.isascii() or _SIGNS.isdisjoint(low) else low.translate(_BLANKS))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its borders marked; a shorter word has none."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Entries:
    """The words, or the n-grams of one order: logs of the languages that have them, side by side.

    A language that lacks an entry has its `floor`, the log of the smoothing alone. So a model
    grows with the entries that its languages have, not with entries times languages.
    """

    def __init__(self, at: dict[str, int], ends: np.ndarray, columns: np.ndarray, logs: np.ndarray, floor: np.ndarray):
        self.at, self.floor = at, floor
        self._starts = np.concatenate([[0], ends]).astype(np.int64)
        self._columns, self._above = columns, (logs - floor[columns]).astype(np.float32)

    @classmethod
    def of_logs(cls, table: dict[str, np.ndarray], width: int) -> Entries:
        """Entries that every language has."""
        n = len(table)
        logs = np.array(list(table.values()), np.float32).reshape(-1)
        columns = np.tile(np.arange(width), n)
        return cls(dict(zip(table, range(n), strict=True)), width * np.arange(1, n + 1), columns, logs, np.zeros(width))

    @classmethod
    def of_counts(cls, grams: list[str], ends: array, columns: array, counts: array, width: int) -> Entries:
        """Smoothed log frequencies of counts; those of entry i end at `ends[i]`."""
        at, n = np.array(columns, np.int64), np.array(counts, np.float64)
        totals = np.bincount(at, n, width) + SMOOTHING * max(len(grams), 1)
        logs = np.log((n + SMOOTHING) / totals[at])
        names = dict(zip(grams, range(len(grams)), strict=True))
        return cls(names, np.array(ends, np.int64), at, logs, np.log(SMOOTHING / totals))

    def means(self, places: list[int], counts: list[int]) -> np.ndarray:
        """A row of mean logs for each group of `counts[i]` successive places."""
        groups = np.array(counts)
        starts = self._starts[places]
        sizes = self._starts[np.array(places) + 1] - starts
        group = np.repeat(np.repeat(np.arange(len(groups)), groups), sizes)
        cells = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        width = len(self.floor)
        sums = np.bincount(group * width + self._columns[cells], self._above[cells], len(groups) * width)
        return self.floor + sums.reshape(len(groups), width) / groups[:, None]


class LanguageModel:
    """Log frequencies per language of words (order 0) and of n-grams of 1 to LONGEST letters.

    The evidence of words that were seen lately is remembered in a matrix with a column per
    language, of bounded size.
    """

    def __init__(
        self, languages: list[str], prior: np.ndarray, tables: list[dict[str, np.ndarray]] | list[Entries]
    ) -> None:
        self.languages, self.prior = languages, prior
        width = len(languages)
        self._orders = [t if isinstance(t, Entries) else Entries.of_logs(t, width) for t in tables]
        self._at = [order.at for order in self._orders]
        self._memory = max(1, min(MEMORY, CELLS // (width + 1)))
        self._part = max(1, min(PART, self._memory // 4))
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_evidence")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Drop the remembered evidence."""
        self._known: dict[str, int] = {}
        self._evidence = np.zeros((0, len(self.languages) + 1), np.float32)

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row per word: its logs per language, and 1 if there is any evidence.

        A known word has its own frequencies. Another one has the mean of its known n-grams of
        the longest order of which it has any.
        """
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        places: list[list[int]] = [[] for _ in self._at]
        owners: list[list[int]] = [[] for _ in self._at]
        counts: list[list[int]] = [[] for _ in self._at]
        for i, word in enumerate(words):
            at = self._at[0].get(word)
            found = [] if at is None else [at]
            order, marked = 0, f"<{word}>"
            n = LONGEST
            while not found and n:
                order, table = n, self._at[n]
                found = [p for k in range(len(marked) - n + 1) if (p := table.get(marked[k : k + n])) is not None]
                n -= 1
            if found:
                places[order] += found
                owners[order].append(i)
                counts[order].append(len(found))
        for order, at in enumerate(places):
            if at:
                out[owners[order], :-1] = self._orders[order].means(at, counts[order])
                out[owners[order], -1] = 1
        return out

    def _places(self, words: list[str]) -> list[int]:
        """The rows of words in the remembered evidence; that of new words is computed together."""
        at = list(map(self._known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, p in zip(words, at, strict=True) if p is None))
            if len(self._known) + len(new) > self._memory:
                self.forget()
                new = list(dict.fromkeys(words))
            start = len(self._known)
            end = start + len(new)
            if end > len(self._evidence):
                grown = np.zeros((max(end, 2 * len(self._evidence), 1000), self._evidence.shape[1]), np.float32)
                grown[:start] = self._evidence[:start]
                self._evidence = grown
            self._evidence[start:end] = self.evidence(new)
            self._known.update(zip(new, range(start, end), strict=True))
            at = list(map(self._known.__getitem__, words))
        return at

    def _totals(self, docs: list[list[str]]) -> np.ndarray:
        """A row per document: the sum of its words' evidence."""
        out = np.zeros((len(docs), self._evidence.shape[1]))
        at = self._places([w for words in docs for w in words])
        sizes = np.array([len(words) for words in docs])
        filled = np.flatnonzero(sizes)
        if len(filled):
            starts = np.cumsum(sizes) - sizes
            out[filled] = np.add.reduceat(self._evidence[at], starts[filled], axis=0, dtype=np.float64)
        return out

    def _verdict(self, total: np.ndarray, words: int) -> tuple[str, float]:
        scored = total[-1]
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if not scored:
            return self.languages[int(self.prior.argmax())], 0.0
        logs = total[:-1] * (min(scored, EVIDENCE) / scored) + self.prior
        chances = np.exp(logs - logs.max())
        best = int(chances.argmax())
        return self.languages[best], float(chances[best] / chances.sum() * scored / words)

    def predictions(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of every text, of which groups with a bounded number of words are
        looked up together; a text with more words is taken in parts.

        The score is the posterior of at most EVIDENCE average words, times the share of words with
        any evidence.
        """
        group: list[list[str]] = []
        size = 0

        def flushed() -> Iterator[tuple[str, float]]:
            for total, words in zip(self._totals(group), group, strict=True):
                yield self._verdict(total, len(words))

        for text in texts:
            words = words_of(text) if text else []
            if size + len(words) > self._part:
                yield from flushed()
                group, size = [], 0
            if len(words) > self._part:
                parts = (words[i : i + self._part] for i in range(0, len(words), self._part))
                yield self._verdict(sum(self._totals([part])[0] for part in parts), len(words))
            else:
                group.append(words)
                size += len(words)
        yield from flushed()

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text."""
        return next(self.predictions([text]))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, rows in batch.groupby("lang")["text"]:
            found = Counter(w for text in rows for w in words_of(text))
            for word, n in found.items():
                counts[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        counts[lang, size, gram] += n
        yield pd.DataFrame(
            [(lang, size, gram, n) for (lang, size, gram), n in counts.items()],
            columns=["lang", "size", "gram", "n"],
        )


def _most_frequent(totals: DataFrame, max_entries: int) -> DataFrame:
    """The `max_entries` most frequent grams of every language and order; ties go to the first by name.

    Shares of the grams are ranked first, so the last ranking sees a bounded number of rows.
    """
    order = [F.desc("n"), F.col("gram")]
    salted = totals.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    for keys in (["size", "lang", "salt"], ["size", "lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("place", place).where(F.col("place") <= max_entries)
    return salted.select("size", "gram").distinct()


def train(docs: DataFrame, per_language: int = 1500, max_entries: int = 10_000) -> LanguageModel:
    """Learn every language from text and non-null lang of documents that are not held out.

    The sample is bounded: about `per_language` documents of each language, whole texts. Of words
    and of each n-gram order the `max_entries` most frequent of every language are kept, which
    bounds the model that is sent to the tasks by the number of languages.
    """
    usable = docs.select(F.col("doc_id").cast("bigint"), "text", F.col("lang").cast("string")).where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    with Scratch(docs.sparkSession, "language") as scratch:
        sizes = scratch.written(usable.groupBy("lang").agg(F.count("*").alias("available")), "sizes")
        by_name = {r["lang"]: r["available"] for r in sizes.collect()}
        languages = sorted(by_name)
        if not languages:
            return LanguageModel([], np.zeros(0), [{} for _ in range(LONGEST + 1)])
        sample = usable.join(small_side(sizes), "lang").where(sampled("doc_id", F.col("available"), per_language))
        counts = sample.select("lang", "text").mapInPandas(
            lean(_counted), "lang string, size int, gram string, n bigint"
        )
        totals = scratch.written(counts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")), "totals")
        kept = totals.join(_most_frequent(totals, max_entries), ["size", "gram"], "left_semi")
        by_gram = kept.groupBy("size", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("found"))
        index = {lang: i for i, lang in enumerate(languages)}
        grams: list[list[str]] = [[] for _ in range(LONGEST + 1)]
        ends, columns, numbers = ([array("q") for _ in grams] for _ in range(3))
        for row in by_gram.toLocalIterator():
            size = row["size"]
            grams[size].append(row["gram"])
            for lang, n in row["found"]:
                columns[size].append(index[lang])
                numbers[size].append(n)
            ends[size].append(len(columns[size]))
    orders = [Entries.of_counts(*parts, len(languages)) for parts in zip(grams, ends, columns, numbers, strict=True)]
    share = np.array([by_name[lang] for lang in languages], float)
    return LanguageModel(languages, np.log(share / share.sum()), orders)


def predictor(spark: SparkSession, model: LanguageModel):
    """A function of a text column that gives struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame(list(own.predictions(texts)), columns=["lang_pred", "score"])
        own.forget()

    return F.pandas_udf(lean(predict), "lang_pred string, score double")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score, from the text alone.

    A null text, or one without a letter, is `und` with score 0. A text of letters without
    any evidence gets the most frequent learned language with score 0. Equal scores go to
    the first language by name. Without anything to learn from, every text is `und`.
    """
    found = predictor(docs.sparkSession, model)(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    scored = rows.select("doc_id", held_out().alias("held_out"), found.alias("found"))
    return scored.select("doc_id", "held_out", "found.lang_pred", "found.score")

