"""Toxicity by a factorization machine over hashed terms.

A document's features are the presence of hashed words and of hashed beginnings of words.  Of the 2^BITS buckets the `terms` with the strongest
association with the label (signed chi-squared over the training rows) are kept; the machine learns a weight
for each and, through `rank` factors, for each pair of terms that meet in a document, so that an
insult beside a group mention can count for more than their sum, which an additive model misses.

It is fitted on at most `train_rows` distinct (text, label) rows with the least hashes, bounded by parameter; the
features, the labels and the fitted model that pass through the driver are bounded by it too.

Null and empty texts score the machine's bias.  Rows with a null label are not learned from; a text with
both labels counts once for each, and copies with one label count once.  If one class is missing, every score is the base rate,
smoothed towards 0.05.  Very long texts are hashed whole, a megabyte at a time.  A score equal to the threshold is predicted
1; terms of equal association are taken by their bucket.  Repeated rows are scored each, an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, distinct_sample, wide_rows
from .hashing import encode, slices, words

BITS = 20
PREFIXES = (5, 6, 7)  # bytes; stems of compounds and of inflected words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def present(texts: list[bytes], index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct buckets of each text; with an index, (text number, feature)
    of those that it has."""
    who, value = words(texts, prefixes=PREFIXES)
    bucket = (value >> np.uint64(64 - BITS)).astype(np.int64)
    if index is not None:
        bucket = index[bucket]
        who, bucket = who[bucket >= 0], bucket[bucket >= 0]
    both = np.unique(who << BITS | bucket)
    return both >> BITS, both & (1 << BITS) - 1


@dataclass
class FactorizationMachine:
    buckets: np.ndarray  # bucket of each feature
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features x rank

    def index(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int64)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def logits(self, n: int, who: np.ndarray, feature: np.ndarray) -> np.ndarray:
        out = self.bias + np.bincount(who, self.weights[feature], n)
        for f in self.factors.T:
            out += 0.5 * (np.bincount(who, f[feature], n) ** 2 - np.bincount(who, f[feature] ** 2, n))
        return out

    def score(self, texts: list[bytes], index: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, part in slices(texts):
            out[at : at + len(part)] = _sigmoid(self.logits(len(part), *present(part, index)))
        return out


def train(buckets: np.ndarray, n: int, who: np.ndarray, feature: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 250, rate: float = 0.05, decay: float = 3e-4) -> FactorizationMachine:
    """Full-batch Adam on the log loss; sums over texts and features are bincounts."""
    rng, size = np.random.default_rng(5), len(buckets)
    base = (y.sum() + 0.5) / (n + 1)
    p = np.concatenate([[np.log(base / (1 - base))], np.zeros(size), rng.normal(0, 0.05, size * rank)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, epochs + 1):
        fm = FactorizationMachine(buckets, p[0], p[1 : 1 + size], p[1 + size :].reshape(size, rank))
        error = (_sigmoid(fm.logits(n, who, feature)) - y) / n
        g = np.zeros_like(p)
        g[0] = error.sum()
        e = error[who]
        g[1 : 1 + size] = np.bincount(feature, e, size)
        for f in range(rank):
            col = fm.factors[:, f]
            sums = np.bincount(who, col[feature], n)
            g[1 + size + f :: rank] = np.bincount(feature, e * (sums[who] - col[feature]), size)
        g[1:] += decay * p[1:] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return FactorizationMachine(buckets, float(p[0]), p[1 : 1 + size], p[1 + size :].reshape(size, rank))


def fit_toxicity(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, terms: int = 2048, rank: int = 6, least_docs: int = 4) -> FactorizationMachine:
    """A machine fitted on rows (text, label 0/1)."""
    wide_rows(rows.sparkSession)
    rows = rows.filter(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"))
    rows = cut(distinct_sample(rows, "text", train_rows, 7, ["y"]), "taught")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        size = np.zeros(2, np.int64)
        for pdf in batches:
            y = (pdf["y"].to_numpy() > 0).astype(np.int64)
            size += np.bincount(y, minlength=2)
            for at, part in slices([encode(t) for t in pdf["text"]]):
                who, bucket = present(part)
                for label in (0, 1):
                    sums[label] += np.bincount(bucket[y[at + who] == label], minlength=1 << BITS)
        at = np.nonzero(sums.sum(0))[0]
        if size.sum():
            yield pd.DataFrame({"bucket": np.append(at, -1), "n0": np.append(sums[0, at], size[0]), "n1": np.append(sums[1, at], size[1])})

    counts = rows.mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = counts.filter(F.col("n0") + F.col("n1") >= least_docs).toPandas()  # 2^BITS rows at most
    whole = got[got["bucket"] < 0]
    got = got[got["bucket"] >= 0]
    n0, n1 = (int(whole["n0"].sum()), int(whole["n1"].sum())) if len(whole) else (0, 0)
    if not n0 or not n1 or not len(got):
        base = (n1 + 0.5) / (n0 + n1 + 10)  # without evidence a document counts as clean
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, rank)))
    a, b = got["n1"].to_numpy(float), got["n0"].to_numpy(float)
    expected = (a + b) * n1 / (n0 + n1)
    chi = (a - expected) ** 2 / expected + (b - (a + b - expected)) ** 2 / (a + b - expected)
    best = np.lexsort((got["bucket"].to_numpy(), -chi))[:terms]
    best = best[chi[best] > 15]  # one in ten thousand by chance
    buckets = np.sort(got["bucket"].to_numpy()[best])
    fm = FactorizationMachine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), rank)))
    index = fm.index()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own: list[list[int]] = [[] for _ in range(len(pdf))]
            for at, part in slices([encode(t) for t in pdf["text"]]):
                for i, f in zip(*(x.tolist() for x in present(part, index)), strict=True):
                    own[at + i].append(f)
            yield pd.DataFrame({"y": (pdf["y"] > 0).astype("int32"), "f": own})

    sample = rows.mapInPandas(features, "y int, f array<int>").toPandas()  # train_rows rows at most, a few terms each
    sizes = sample["f"].map(len).to_numpy()
    who = np.repeat(np.arange(len(sample)), sizes)
    feature = np.concatenate([np.asarray(f, np.int64) for f in sample["f"]]) if sizes.sum() else np.zeros(0, np.int64)
    return train(buckets, len(sample), who, feature, sample["y"].to_numpy(float), rank)


def toxicity_score(text: Column, model: FactorizationMachine, spark) -> Column:
    """The machine's probability that the label is 1."""
    wide_rows(spark)
    shared = spark.sparkContext.broadcast(model)  # `terms` x (rank + 2) numbers

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        index = m.index()
        for texts in batches:
            yield pd.Series(m.score([encode(t) for t in texts], index))

    return of(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, score, predicted (1 if score >= threshold): a row for each row of docs."""
    out = docs.select(id_col, toxicity_score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
