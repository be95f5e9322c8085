"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams.  A document is a mixture of languages:
expectation-maximisation estimates the proportions, and the set of languages is the prefix (languages
by falling proportion) with the best likelihood less `penalty` * log(trigrams) for each language, so a second language
must earn its place.  The prediction is the language with the largest share of the chosen set, and the score
is that share.

The model is fitted on about `language_rows` distinct texts of each language (a parameter), those with the least hashes; a
language with fewer is learned whole, so none is lost for being rare.  The driver gathers one row of packed counts for each language, 128 KB at
2^15 buckets, and every worker holds the table of their logarithms, as large: 64 MB at 512 languages.  More than
`most_languages` labels (a column that holds no languages) are an error, not a cut.

Rows with null text or without a letter get `und`, score 0 and an empty mixture, as does everything when
nothing can be learned (no labelled text); null languages are not learned from.  Very long texts are read whole; languages with
equal shares come by name.  Repeated rows are judged each, copies of a text are learned as often as they are there; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import wide_rows
from .hashing import encode, trigrams


@dataclass
class LanguageModel:
    languages: list[str]
    bits: int = 15
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # buckets x languages
    penalty: float = 6.0
    rounds: int = 12

    def mixture(self, text: bytes) -> list[tuple[str, float]]:
        """Chosen languages and their shares, largest first (ties: by name)."""
        grams = trigrams(text, self.bits)
        if not len(grams) or not self.languages:
            return []
        counts = np.bincount(grams, minlength=1 << self.bits)
        seen = np.nonzero(counts)[0]
        c, log_p = counts[seen].astype(np.float64), self.log_p[seen].astype(np.float64)
        single = c @ log_p
        top = log_p.max(1, keepdims=True)
        p = np.exp(log_p - top)
        total, base = c.sum(), float(c @ top[:, 0])

        def em(p: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
            for _ in range(self.rounds):
                share = share * ((c / np.maximum(p @ share, 1e-300)) @ p) / total
            return share, base + float(c @ np.log(np.maximum(p @ share, 1e-300)))

        share, _ = em(p, np.full(len(self.languages), 1 / len(self.languages)))
        first = int(np.argmax(single))
        order = [first, *(i for i in np.argsort(-share, kind="stable") if i != first)]
        cost = self.penalty * np.log(total + 1)
        best, kept, shares = single[first] - cost, order[:1], np.ones(1)
        for n in range(2, len(order) + 1):
            if share[order[n - 1]] < 0.01:
                break
            got, value = em(p[:, order[:n]], np.maximum(share[order[:n]], 0.01) / np.maximum(share[order[:n]], 0.01).sum())
            if value - n * cost <= best:
                break
            best, kept, shares = value - n * cost, order[:n], got
        shares = shares / shares.sum()
        return sorted(((self.languages[i], float(s)) for i, s in zip(kept, shares, strict=True)), key=lambda x: (-x[1], x[0]))


def has_letter(text: str) -> bool:
    return any(unicodedata.category(ch)[0] == "L" for ch in text)


def fit_languages(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", language_rows: int = 5000, most_languages: int = 512, bits: int = 15) -> LanguageModel:
    """A model of the rows whose text and language are not null."""
    rows = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("turn", F.xxhash64("text", F.lit(7)))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n")).limit(most_languages + 1)
    limits = [(r["lang"], int(-(1 << 63) + min(1.2 * language_rows / r["n"], 1.0) * (1 << 64)) - 1) for r in sizes.collect()]
    if len(limits) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    limit = rows.sparkSession.createDataFrame([(a, max(b, -(1 << 63))) for a, b in limits], "lang string, limit long")  # most_languages rows at most
    rows = rows.join(F.broadcast(limit), "lang").filter("turn <= limit").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                if lang not in sums and len(sums) == 256:  # a task holds the counts of 256 languages at a time
                    yield from told(sums)
                    sums.clear()
                own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                own += np.bincount(trigrams(encode(text), bits), minlength=1 << bits)
        yield from told(sums)

    def told(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, own in sums.items():
            at = np.nonzero(own)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, at, n in pdf[["lang", "at", "n"]].itertuples(index=False):
                own = np.zeros(1 << bits, np.float32)
                own[at] = n
                yield pd.DataFrame({"lang": [lang], "counts": [own.tobytes()]})

    got = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = got.groupBy("lang").agg(F.collect_list(F.struct(F.col("bucket").alias("at"), "n")).alias("c"))  # 2^bits cells at most
    got = got.select("lang", "c.at", "c.n").mapInPandas(packed, "lang string, counts binary").toPandas().sort_values("lang")
    languages = list(got["lang"])
    table = np.full((1 << bits, len(languages)), 0.5, np.float32)
    for i, counts in enumerate(got["counts"]):
        table[:, i] += np.frombuffer(counts, np.float32)
    return LanguageModel(languages, bits, np.log(table / table.sum(0, dtype=np.float64)).astype(np.float32) if languages else np.zeros((1 << bits, 0), np.float32))


def language_mixture(text: Column, model: LanguageModel, spark) -> Column:
    """struct<lang, score, languages array<struct<lang, share>>> of a text."""
    wide_rows(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^bits x 4 bytes for each language, 64 MB at the most_languages bound

    part = T.StructType().add("lang", T.StringType()).add("share", T.DoubleType())

    @F.pandas_udf(T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()).add("languages", T.ArrayType(part)))
    def of(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            found = m.mixture(encode(t)) if t and has_letter(t) else []
            out.append((*(found[0] if found else ("und", 0.0)), [{"lang": a, "share": b} for a, b in found]))
        return pd.DataFrame(out, columns=["lang", "score", "languages"])

    return of(text)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, languages: a row for each row of docs."""
    out = docs.select(F.col(id_col), language_mixture(F.col(text_col), model, docs.sparkSession).alias("__m"))
    return out.select(id_col, F.col("__m.lang").alias("lang_pred"), F.col("__m.score").alias("score"), F.col("__m.languages").alias("languages"))
