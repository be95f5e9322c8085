"""Document quality from weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Their patterns of votes are counted over all
documents (3^labellers patterns at most, so the counts are bounded), and expectation-maximisation on the counts estimates
the share of good documents and, for each labeller, how often its votes are right on good and on bad ones, starting
from "labellers are right more often than not"; a labeller that does not vote says nothing.  Posteriors of the patterns are the labels that train a linear
scorer over hashed byte trigrams alone (the labellers' votes are no features, so it cannot copy them), on at most
`train_rows` distinct texts with the least hashes (the bound is a parameter); it can then score documents on which no labeller votes.

Null text counts as empty and gets the prior.  Repeated rows count each in the patterns; copies of a text teach the scorer
once.  Very long texts are read whole; a task holds one batch of texts.  Ties at the threshold are kept.  If the table is empty,
nothing is scored.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_sample, wide_rows
from .hashing import encode

LABELLERS = ["symbols", "capitals", "bars", "word_length", "repeats", "sentences", "short_words", "stutter"]
BITS = 11
SYMBOLS = np.array([c in b"#$%&*^~<>{}[]\\|=_@+" for c in range(256)])
UPPER = np.array([65 <= c <= 90 for c in range(256)])
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def votes(text: bytes) -> list[int]:
    """0 bad, 1 nothing, 2 good, for each labeller."""
    words = text.split()
    n = len(words)
    if not n:
        return [1] * len(LABELLERS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, seen = max(int(counts[LETTER].sum()), 1), len(text) - n + 1
    between = lambda x, bad, good: 0 if x > bad else 2 if x < good else 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = int(counts[46] + counts[33] + counts[63])
    distinct = len(set(words)) / n
    return [
        between(counts[SYMBOLS].sum() / seen, 0.05, 0.01),
        between(counts[UPPER].sum() / letters, 0.3, 0.12),
        between(counts[124] / n, 0.15, 0.02),
        2 if 3 <= lengths.mean() <= 9 else 0 if lengths.mean() > 12 or lengths.mean() < 2 else 1,
        1 if n < 50 else 0 if distinct < 0.25 else 2 if distinct > 0.35 else 1,
        1 if n < 20 else 0 if ends / n < 0.01 or ends / n > 0.6 else 2 if 0.03 <= ends / n <= 0.3 else 1,
        1 if n < 20 else 0 if (lengths <= 3).mean() < 0.08 else 2 if (lengths <= 3).mean() > 0.2 else 1,
        1 if n < 5 else between(sum(map(bytes.__eq__, words, words[1:])) / (n - 1), 0.2, 0.05),
    ]


def pattern(text: bytes) -> int:
    out = 0
    for v in votes(text):
        out = out * 3 + v
    return out


def features(text: bytes) -> np.ndarray:
    """Square roots of hashed byte trigram counts (case and punctuation kept, letters beyond ASCII as one) at unit
    length."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    b = np.where(b >= 128, 128, b)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) if len(b) > 2 else np.zeros(0, np.uint32)
    x = np.sqrt(np.bincount(h.astype(np.int64), minlength=1 << BITS)).astype(np.float32)
    return x / max(float(np.sqrt((x**2).sum())), 1e-9)


@dataclass
class LabelModel:
    good: float  # share of good documents
    chance: np.ndarray  # class (bad, good) x labeller: chance that a vote, if cast, is "good"

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document is good.  A labeller that does not vote says nothing."""
        v = _split(patterns)
        yes, no = (v == 2).astype(float), (v == 0).astype(float)
        log = np.log([1 - self.good, self.good])[:, None] + np.log(self.chance) @ yes.T + np.log(1 - self.chance) @ no.T
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller's vote is right, for documents of either class in equal number."""
        return dict(zip(LABELLERS, ((1 - self.chance[0] + self.chance[1]) / 2).tolist(), strict=True))


def _split(patterns: np.ndarray) -> np.ndarray:
    n = len(LABELLERS)
    return np.stack([patterns // 3 ** (n - 1 - j) % 3 for j in range(n)], axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior_share: float = 0.05) -> LabelModel:
    """Expectation-maximisation over counted patterns.  The prior, worth `prior_share` of the documents for each labeller at every
    size (labellers overlap, so more documents do not make up for it), says that good documents rarely get a vote for bad, and
    bad ones about as often as not."""
    v, total = _split(patterns), counts.sum()
    n, prior = len(LABELLERS), max(2.0, total * prior_share)
    guess = np.stack([np.full(n, 0.6), np.full(n, 0.97)])
    model = LabelModel(0.85, guess)
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        yes, cast = weight @ (v == 2), weight @ (v != 1)
        chance = np.clip((yes + prior * guess) / (cast + prior), 1e-4, 1 - 1e-4)
        share = float((weight[1].sum() + 1) / (total + 2))
        done = abs(share - model.good) < 1e-9
        model = LabelModel(share, chance)
        if done:
            break
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    bias: float
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        z = self.bias + float(features(text) @ self.weights) if text.strip() else float(np.log(self.labels.good / (1 - self.labels.good)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fit_quality(docs: DataFrame, text_col: str = "text", train_rows: int = 4000, steps: int = 300) -> QualityModel:
    wide_rows(docs.sparkSession)

    @F.pandas_udf(T.IntegerType())
    def pattern_of(texts: pd.Series) -> pd.Series:
        return pd.Series([pattern(encode(t)) for t in texts], dtype="int32")

    got = docs.select(pattern_of(_text(text_col)).alias("p")).groupBy("p").count().toPandas()  # 3^8 rows at most
    n = int(got["count"].sum())
    if not n:
        return QualityModel(LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5)), 0.0, np.zeros(1 << BITS))
    labels = fit_labels(got["p"].to_numpy(np.int64), got["count"].to_numpy(float))
    rows = distinct_sample(docs.select(_text(text_col).alias("text")), "text", train_rows, 11)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"p": [pattern(t) for t in raw], "x": [features(t).tobytes() for t in raw]})

    kept = rows.mapInPandas(sample, "p int, x binary").toPandas()  # train_rows rows of 8 KB
    if kept.empty:
        return QualityModel(labels, float(np.log(labels.good / (1 - labels.good))), np.zeros(1 << BITS))
    x = np.frombuffer(b"".join(kept["x"]), np.float32).reshape(len(kept), -1)
    y = labels.posterior(kept["p"].to_numpy(np.int64))
    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):  # Adam on the log loss against the posteriors
        e = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -40, 40))) - y) / len(y)
        g = np.append(x.T @ e.astype(np.float32) + 1e-5 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return QualityModel(labels, float(b), w)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, weak_label (posterior of the labellers), score, keep (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    @F.pandas_udf(T.StructType().add("weak_label", T.DoubleType()).add("score", T.DoubleType()))
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        raw = [encode(t) for t in texts]
        weak = m.labels.posterior(np.array([pattern(t) for t in raw], np.int64)) if raw else np.zeros(0)
        return pd.DataFrame({"weak_label": weak, "score": np.array([m.score(t) for t in raw], float)})

    out = docs.select(id_col, of(_text(text_col)).alias("__q"))
    return out.select(id_col, F.col("__q.weak_label").alias("weak_label"), F.col("__q.score").alias("score"), (F.col("__q.score") >= threshold).cast("int").alias("keep"))
