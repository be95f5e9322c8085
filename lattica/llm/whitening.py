"""Whitening of embeddings: principal components from a pivoted Cholesky factor by one-sided Jacobi rotations.

Passes over the vectors are Spark jobs: sums per dimension, the centred scatter, the projection.  Each partition adds up its own rows and
passes on numbers that depend on the dimension alone, which Spark sums by their place.  What reaches the driver is the
scatter matrix, dimension x dimension.  There it becomes L L' by Cholesky with pivots (the largest remaining diagonal entry first, so
a scatter without full rank ends early), and the columns of L are rotated in pairs until they are orthogonal.  Their squared
norms are then the eigenvalues, and the normalised columns the components.  V = L L' is never formed again, so small
eigenvalues keep their relative precision.

Entries are integers, so sums and deviations are exact: Python integers where 64 bits could overflow.

A null vector, one with null or non-finite entries, with an entry whose integer does not fit 53 bits, an empty one, or one of another length
than most vectors have (ties: the longer) takes no part.  Rows with a null key, repeated rows and ties between eigenvalues are kept as they are; the components of equal eigenvalues are any orthonormal
basis of their space.  Directions without variance have no whitened values, so constant vectors, a single row and an empty table give no rows.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = 2**53  # integers below it are doubles


def integer_rows(df: DataFrame, key: str, vector: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """key, x: floor(scale * c) + shift of every entry, for vectors that take part by their entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < float(EXACT - shift)))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine).select(F.col(key).alias("key"), x.alias("x"))


def _matrix(x: pd.Series, like: str = "int64") -> np.ndarray:
    return np.array(x.tolist(), dtype=like)


def _add_up(rows: DataFrame, each, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """Sum over all rows of each(batch) (an array of `shape`): by partitions first, then by places."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = each(_matrix(b["x"]))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "v": total.ravel() if kind == "double" else [str(int(v)) for v in total.ravel()]})

    out = np.zeros(int(np.prod(shape)), dtype=float if kind == "double" else object)
    as_number = "double" if kind == "double" else "decimal(38,0)"
    found = rows.mapInPandas(part, f"place int, v {'double' if kind == 'double' else 'string'}").groupBy("place").agg(F.sum(F.col("v").cast(as_number)).alias("v"))
    for r in found.collect():  # a row for each place: bounded by the dimension
        out[r["place"]] = float(r["v"]) if kind == "double" else int(r["v"])
    return out.reshape(shape)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows x rank) with L L' = a, for a symmetric positive semidefinite matrix."""
    rest, columns = a.astype(float).copy(), []
    floor = np.trace(rest) * len(rest) * np.finfo(float).eps
    for _ in range(len(rest)):
        p = int(np.argmax(np.diag(rest)))
        if not rest[p, p] > floor:
            break
        col = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(col)
        rest -= np.outer(col, col)
        rest[p, :] = rest[:, p] = 0.0
    return np.array(columns).T if columns else np.zeros((len(a), 0))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, components as columns) of factor @ factor.T: its columns, rotated until all pairs are orthogonal."""
    g = factor.copy()
    n = g.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(n - 1):
            for j in range(i + 1, n):
                a, b, c = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(c) <= 1e-15 * np.sqrt(a * b):
                    continue
                turned = True
                t = (b - a) / (2 * c)
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                cos = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = cos * g[:, i] - cos * t * g[:, j], cos * t * g[:, i] + cos * g[:, j]
        if not turned:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], (g / np.sqrt(values))[:, order]


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums per dimension; eigenvalues of their covariance (divisor n) by falling size, components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit_whitening(rows: DataFrame) -> Whitening:
    """rows: key, x (integer_rows).  All vectors of the most frequent length are the fit list."""
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d, n = sizes["d"], sizes["n"]
    rows = rows.filter(F.size("x") == d)
    sums = _add_up(rows, lambda x: x.astype(object).sum(axis=0) if np.abs(x).max() * len(x) >= 2.0**62 else x.sum(axis=0).astype(object), (d,), "whole")
    whole, rest = np.array([int(s) // n for s in sums], dtype=np.int64), np.array([int(s) % n / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        y = (x - whole).astype(float) - rest  # centred before multiplying; the whole part of the mean goes in integers
        return y.T @ y

    v = _add_up(rows, scatter, (d, d), "double") / n
    values, components = jacobi(pivoted_cholesky((v + v.T) / 2))
    return Whitening(n, [int(s) for s in sums], values, components, float(np.trace(v)))


def whiten(rows: DataFrame, fit: Whitening, most: int = 8) -> DataFrame:
    """key, deviation (decimal: the exact sum over dimensions of (n * x - sum) ** 2), whitened (one value for each of the first `most` components)."""
    n, d, k = fit.n, len(fit.sums), min(most, len(fit.values))
    whole, rest = np.array([s // n for s in fit.sums], dtype=np.int64), np.array([s % n / n for s in fit.sums])
    left = np.array([s % n for s in fit.sums], dtype=object)
    onto = fit.components[:, :k] / np.sqrt(fit.values[:k])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["x"])
            y = x - whole
            white = (y.astype(float) - rest) @ onto
            far = float(np.abs(y).max() + 1) * n
            if far * far * d < 2.0**62:  # fits 64 bits
                z = y * n - left.astype(np.int64)
                deviation = (z * z).sum(axis=1)
            else:
                z = y.astype(object) * n - left
                deviation = (z * z).sum(axis=1)
            yield pd.DataFrame({"key": b["key"], "deviation": [str(v) for v in deviation], "whitened": list(white)})

    kind = T.StructType([rows.schema["key"], T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = rows.filter(F.size("x") == d).mapInPandas(each, kind)
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance (divisor: rows) of the first k whitened values, minus the identity.  Spark's own
    covariance merges centred moments."""
    if not k:
        return 0.0
    at = [F.col("whitened")[i] for i in range(k)]
    entries = [F.abs(F.covar_pop(at[i], at[j]) - float(i == j)) for i in range(k) for j in range(i, k)]
    return float(whitened.agg(F.greatest(*entries, F.lit(0.0)).alias("e")).first()["e"])
