"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm.learning import held_out, sampled
from merchantry.llm.memory import lean
from merchantry.llm.words import split_words

BUCKETS = 4096
BINS = 8
FACTORS = 8
THRESHOLD = 0.7
STATISTICS = (
    "letters", "upper", "digits", "blanks", "stops", "marks", "high_bytes", "word_length", "distinct",
    "most_frequent", "repeated_next", "marked_words", "lines_per_word", "log_words", "log_chars",
)
FEATURES = BUCKETS + len(STATISTICS) * BINS


def _byte_classes() -> np.ndarray:
    """A column per byte class: letters, capitals, digits, blanks, stops, other marks, beyond ASCII."""
    tests = (
        lambda c: c.isalpha(), str.isupper, str.isdigit, str.isspace, lambda c: c in ".,;:'\"-()",
        lambda c: not c.isalnum() and not c.isspace() and c not in ".,;:'\"-()",
    )
    table = np.zeros((256, 7))
    for b in range(256):
        table[b] = [*[b < 128 and test(chr(b)) for test in tests], b >= 128]
    return table


_CLASSES = _byte_classes()


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = zlib.crc32(word) % BUCKETS
        return found


_BUCKETS = _Buckets()


def describe(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words with their weights, and the statistics, of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = split_words(text)
    n = max(len(words), 1)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / max(len(raw), 1)
    at = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    counts = np.bincount(at, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    weights = np.log1p(counts[found])
    weights /= max(np.sqrt((weights**2).sum()), 1e-9)
    marked = sum(w[-1] in b"!#$%&*|+=~^@" for w in words)
    metadata = len(text or "") if n_chars is None or n_chars != n_chars else float(n_chars)
    statistics = np.array(
        [
            *chars, len(raw) / n, len(found) / n, (counts.max() if words else 0) / n,
            (at[1:] == at[:-1]).sum() / n, marked / n, raw.count(b"\n") / n, np.log1p(len(words)),
            np.log1p(max(metadata, 0.0)),
        ]
    )
    return found, weights, statistics


@dataclass
class QualityModel:
    """Bias, linear weights, factors, and the cut points that turn statistics into indicators."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    cuts: np.ndarray

    def row(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        return _row(*describe(text, n_chars), self.cuts)

    def score(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1, in time linear in the features present.

        The sum over pairs of <v_i, v_j> x_i x_j is half of (sum of v_i x_i) squared less the
        sum of (v_i x_i) squared, per factor.
        """
        if not rows:
            return np.zeros(0)
        at = np.concatenate([i for i, _ in rows])
        x = np.concatenate([v for _, v in rows])
        starts = np.cumsum([0, *[len(i) for i, _ in rows[:-1]]])
        scaled = self.factors[at] * x[:, None]
        together = np.add.reduceat(scaled, starts) ** 2
        alone = np.add.reduceat(scaled**2, starts)
        linear = np.add.reduceat(self.weights[at] * x, starts)
        return 1 / (1 + np.exp(-(self.bias + linear + 0.5 * (together - alone).sum(axis=1))))


def _row(found: np.ndarray, weights: np.ndarray, statistics: np.ndarray, cuts: np.ndarray) -> tuple:
    """Indices and values of a text's features: words, and one indicator per statistic."""
    bins = (statistics[:, None] > cuts).sum(axis=1)
    indicators = BUCKETS + np.arange(len(STATISTICS)) * BINS + bins
    return np.concatenate([found, indicators]), np.concatenate([weights, np.ones(len(STATISTICS))])


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [describe(t, n) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
        yield pd.DataFrame(
            {
                "label": batch["label"],
                "found": [f.astype("<u2").tobytes() for f, _, _ in rows],
                "weights": [w.astype("<f4").tobytes() for _, w, _ in rows],
                "statistics": [s.astype("<f8").tobytes() for _, _, s in rows],
            }
        )


def with_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; without that column the length of the text is taken."""
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("bigint"), "text", chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 30) -> QualityModel:
    """Fit on labelled documents that are not held out, about `max_rows` of them.

    Tasks turn whole texts into sparse rows; the driver holds the bounded sample and runs
    stochastic gradient steps of the logistic loss with per-weight step sizes. Labels other
    than 0 and 1 are ignored. Without labelled rows every text scores one half.
    """
    marked = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & ~held_out()).distinct()
    chosen = marked.where(sampled("doc_id", marked.count(), max_rows))
    rows = with_metadata(docs).join(chosen, "doc_id").select("doc_id", "text", "n_chars", "label")
    schema = "label int, found binary, weights binary, statistics binary"
    got = rows.drop("doc_id").mapInPandas(lean(_described), schema).collect()
    got = sorted(got, key=lambda r: (r["label"], bytes(r["statistics"]), bytes(r["found"])))
    empty = np.zeros(FEATURES)
    if not got:
        return QualityModel(0.0, empty, np.zeros((FEATURES, FACTORS)), np.zeros((len(STATISTICS), BINS - 1)))
    statistics = np.array([np.frombuffer(r["statistics"], "<f8") for r in got])
    cuts = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T
    sparse = [
        _row(np.frombuffer(r["found"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<f4"), s, cuts)
        for r, s in zip(got, statistics, strict=True)
    ]
    return _fit(sparse, np.array([r["label"] for r in got], float), cuts, epochs)


def _fit(rows: list[tuple], labels: np.ndarray, cuts: np.ndarray, epochs: int) -> QualityModel:
    rng = np.random.default_rng(7)
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    weights, factors = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS))
    squares = [1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)]
    rate, decay, batch = 0.05, 1e-4, 128
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            own = order[start : start + batch]
            x = np.zeros((len(own), FEATURES))
            for i, r in enumerate(own):
                x[i, rows[r][0]] = rows[r][1]
            used = np.flatnonzero(x.any(axis=0))
            x, v = x[:, used], factors[used]
            together = x @ v
            pairs = 0.5 * (together**2 - (x**2) @ (v**2)).sum(axis=1)
            off = 1 / (1 + np.exp(-(bias + x @ weights[used] + pairs))) - labels[own]
            by_bias = off.mean()
            by_weight = x.T @ off / len(own) + decay * weights[used]
            by_factor = (x.T @ (off[:, None] * together) - ((x**2).T @ off)[:, None] * v) / len(own) + decay * v
            squares[0] += by_bias**2
            squares[1][used] += by_weight**2
            squares[2][used] += by_factor**2
            bias -= rate * by_bias / np.sqrt(squares[0])
            weights[used] -= rate * by_weight / np.sqrt(squares[1][used])
            factors[used] -= rate * by_factor / np.sqrt(squares[2][used])
    return QualityModel(float(bias), weights, factors, cuts)


def scorer(spark: SparkSession, model: QualityModel):
    """A function of the columns text and n_chars that gives the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, n_chars in batches:
            out, chunk = [], []
            for text, n in zip(texts, n_chars, strict=True):
                chunk.append(shared.value.row(text, n))
                if len(chunk) == 500:
                    out.append(shared.value.score(chunk))
                    chunk = []
            out.append(shared.value.score(chunk))
            yield pd.Series(np.concatenate(out))

    return F.pandas_udf(lean(score), "double")


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from `threshold` on).

    A null text scores like an empty one, whose only features are its statistics. A null
    n_chars counts as the length of the text. Repeated rows score alike.
    """
    rows = with_metadata(docs)
    score = scorer(docs.sparkSession, model)(F.col("text"), F.col("n_chars"))
    scored = rows.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
