import math

import numpy as np
import pytest

from lattica.llm import queries as Q
from lattica.llm import whitening as W


def random_rows(n, d, rank, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) * spread ** -np.arange(rank)
    return (x @ rng.normal(size=(rank, d)) + rng.normal(size=d)).astype(np.float32)


def integers(vectors):
    return np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)


def save(spark, tmp_path, rows, kind="vec_id long, embedding array<float>, whitened string, n int"):
    spark.createDataFrame([(*r, None, None) for r in rows], kind).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return Q.op11_whitening(spark, str(tmp_path))


def check(got, ids, x):
    """got: rows of the query.  Everything is held against eigenvalues and vectors of numpy."""
    n, k = len(x), min(8, x.shape[1])
    mean = x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = (x - mean) @ u / np.sqrt(e)
    sums = [int(s) for s in x.sum(axis=0)]
    far = {i: sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for i, r in zip(ids, x, strict=True)}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == n * k
    white = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white * signs, want, atol=1e-7)
    for r in got:
        assert r["n"] == n and r["deviation"] == far[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (e[r["component"] - 1] / np.trace(v)) - 1) < 1e-9


@pytest.mark.parametrize("n,d,spread", [(300, 12, 1.3), (40, 5, 1.0), (500, 24, 2.0)])
def test_against_numpy(spark, tmp_path, n, d, spread):
    vectors = random_rows(n, d, d, n, spread) * 4
    got = save(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(vectors)]).collect()
    check(got, list(range(n)), integers(vectors))


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(Q.op11_whitening(spark, sf).collect(), [r["vec_id"] for r in rows], integers([r["embedding"] for r in rows]))


def test_edge_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, None), (3, [1.0, None]), (4, [3.0, -4.0]), (5, []), (6, [inf, 0.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 0.0])]
    got = save(spark, tmp_path, rows).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["0", "4", "None", "7", "7"] * 2)
    x = integers([r[1] for r in rows if r[0] in (0, 4, 7, None)])
    assert {r["deviation"] for r in got} == {sum((5 * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(axis=0), strict=True)) for r in x}
    assert max(r["identity_error"] for r in got) < 1e-9
    for none in ([], [(1, [1.0, 2.0])], [(i, [5.0, 5.0]) for i in range(9)]):
        out = save(spark, tmp_path, none)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_less_than_full_rank(spark, tmp_path):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 3.0 - i % 5, 1.0]) for i in range(60)]
    got = save(spark, tmp_path, rows).collect()
    assert {r["component"] for r in got} == {1, 2} and abs(sum({r["explained"] for r in got}) - 1) < 1e-9
    assert max(r["identity_error"] for r in got) < 1e-9


def test_deviations_beyond_64_bits_are_exact(spark, tmp_path):
    rows = [(i, [1e12 * (i % 3), 7.0 * i, 5.0]) for i in range(50)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = W.integer_rows(df, "vec_id", "embedding")
    fit = W.fit_whitening(own)
    sums = x.sum(axis=0)
    assert fit.sums == list(sums)
    got = {r["key"]: int(r["deviation"]) for r in W.whiten(own, fit).collect()}
    assert got == {i: sum((50 * c - s) ** 2 for c, s in zip(x[i], sums, strict=True)) for i, _ in rows}
    assert all(r["deviation"] is None for r in save(spark, tmp_path, rows, "vec_id long, embedding array<double>, whitened string, n int").collect())  # does not fit a long


def test_small_eigenvalues_keep_their_precision():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    scale = 10.0 ** -np.linspace(0, 5, 30)
    a = (q * scale) @ q.T
    values, parts = W.jacobi(W.pivoted_cholesky(a))
    assert np.allclose(values, np.sort(scale)[::-1], rtol=1e-9)
    assert np.allclose(parts.T @ parts, np.eye(30), atol=1e-12) and np.allclose((parts * values) @ parts.T, a, atol=1e-14)
