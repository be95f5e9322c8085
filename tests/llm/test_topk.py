import math

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import topk as T


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)), key=lambda x: x)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    c = T.integer_vectors(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in T.top_k(c, c.filter(f"id % {every} = 0"), **more).select("query_id", "rank", "vec_id", "score").collect())


def integers(rows):
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]


def test_matches_brute_force_over_many_norms(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.lognormal(0, 1.2)).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5] * 12) for i in range(40)]  # ties
    rows += [(2000 + i, [0.0] * 12) for i in range(10)]
    rows += [(3000 + i, (-np.abs(rng.normal(size=12))).tolist()) for i in range(60)]
    whole = integers(rows)
    want = brute(whole, [(i, v) for i, v in whole if i % 10 == 0], 5)
    assert run(spark, rows, 10, k=5, block_rows=64, query_rows=30) == want
    assert run(spark, rows, 10, k=5) == want


def test_tight_clusters_use_coordinates(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 16))
    rows = [(i, (centre[i % 8] + rng.normal(size=16) * 0.05).tolist()) for i in range(500)]
    whole = integers(rows)
    assert run(spark, rows, 25, k=3, block_rows=50) == brute(whole, [(i, v) for i, v in whole if i % 25 == 0], 3)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (4, [3.0, 4.0]), (5, []), (6, [float("inf"), 0.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (4, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    c = T.integer_vectors(df, "vec_id", "embedding")
    got = [tuple(r) for r in T.top_k(c, c.filter("id = 0"), k=5).orderBy("rank").select("vec_id", "score").collect()]
    assert got == [(4, 256 * 256 * 11), (4, 256 * 256 * 11), (7, 256 * 256 * 5)]
    assert T.top_k(c.limit(0), c.limit(0)).count() == 0
    assert T.top_k(c, c.filter("id = 10")).count() == 0  # nothing of its dimension


def test_large_components_stay_exact(spark):
    rows = [(0, [3e8, 1.0]), (1, [2.9e8, -5.0]), (2, [-1e8, 7.0]), (3, [1.0, 1.0])]
    whole = integers(rows)
    # beyond 2^53 a double would round; products fit a long here
    got = run(spark, [(i, v) for i, v in rows if i], 3, k=2)
    assert got == brute([w for w in whole if w[0]], [w for w in whole if w[0] == 3], 2)


def test_more_partitions_than_asked_for_lose_nothing(spark, monkeypatch):
    """Blocks are data: whatever number of partitions Spark makes, every block meets the queries that need it."""
    from pyspark.sql.classic.dataframe import DataFrame

    plain = DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, n, *cols: plain(df, max(n, 17), *cols))
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=10) * rng.lognormal(0, 1.0)).tolist()) for i in range(600)]
    rows += [(700 + i, [0.25] * 10) for i in range(30)]
    whole = integers(rows)
    want = brute(whole, [(i, v) for i, v in whole if i % 10 == 0], 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert run(spark, rows, 10, k=5, block_rows=100, query_rows=16) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_out_of_reach_get_no_queries(spark):
    """A few long vectors answer everything: short ones are copied to no group."""
    rng = np.random.default_rng(9)
    centre = np.abs(rng.normal(size=8))
    rows = [(i, (centre * (50 if i < 64 else 0.5) + rng.normal(size=8) * 0.01).tolist()) for i in range(512)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    c = T.integer_vectors(df, "vec_id", "embedding")
    seen = []
    keep, T.cut = T.cut, lambda d, name: seen.append((name, keep(d, name))) or seen[-1][1]
    try:
        got = T.top_k(c, c.filter("id % 10 = 0"), k=5, block_rows=64, query_rows=32).count()
    finally:
        T.cut = keep
    tables = dict(seen)
    assert got == 5 * 52 and tables["block"].count() == 512  # eight blocks
    assert {r["block"] for r in tables["pairs"].collect()} <= {0, 1}
