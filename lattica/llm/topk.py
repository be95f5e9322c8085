"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: sorted by falling norm (ties by id) over range partitions, and every `block_rows` in that
order are a block.  Each vector's place in the order is written with it, so blocks are data: however many
partitions Spark makes, they are the same, and the table of blocks (largest norm of each) says which there are.  The `block_rows`
longest vectors (a fixed bound, so they may be broadcast) give each query a first bound b: its k-th best score
there.  A query of norm |q| needs only blocks whose largest norm is b / |q| or more.  Queries are grouped by that need,
and pairs of (query group, block) are formed from the two small tables before any vector is copied.

Where they meet, with the block's largest norm M, a query has the local cosine threshold b / (|q| M).  A high threshold
prunes by coordinates: a vector that reaches the cosine lies, in each of the query's `focus` strongest coordinates, in
an interval around it; a low one prunes by length: vectors no longer than b / |q| go.  What is left is verified with
exact integer products.

Bounds only ever drop vectors that cannot be among the k best, ties included, so results are exact.  Vectors null or
holding null or non-finite components, and rows with null id, take no part; vectors of other lengths in components than the
query's don't meet it.  Repeated candidate rows are candidates each.  An id names a query: its repeated equal rows are one
query, and different vectors under one id all ask for it.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

COORDINATES_FROM = 0.55  # local cosine threshold from which coordinates prune better than length
SLACK = 1e-6  # relative, on the side of keeping


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """id, v array<long> = floor(scale * x), dim, norm2: finite whole vectors only."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)))
    out = df.filter(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")).alias("norm2"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles only where those are exact."""
    most = np.abs(q).max(initial=0) * float(np.abs(c).max(initial=0)) * q.shape[-1]
    return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if most < 2**52 else c @ q


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.nonzero(score >= floor)[0]
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def search_block(cid: np.ndarray, c: np.ndarray, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, focus: int = 3) -> list[tuple[int, int, int]]:
    """(query, id, score): the k best of the block for each query that can beat or tie its bound."""
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((cid, -norm))
    cid, c, norm = cid[order], c[order], norm[order]
    unit = c / np.maximum(norm, 1e-300)[:, None]
    longest, out = norm[0] if len(norm) else 0.0, []
    for i in range(len(qid)):
        own = q[i].astype(np.float64)
        size = float(np.sqrt((own**2).sum()))
        b = bound[i]
        at = slice(0, len(cid))
        if b > 0 and size > 0:
            cosine = b / (size * longest) * (1 - SLACK) if longest else 2.0
            if cosine > 1:
                continue
            if cosine >= COORDINATES_FROM:  # coordinates
                u = own / size
                keep = np.ones(len(cid), bool)
                for f in np.argsort(-np.abs(u), kind="stable")[:focus]:
                    spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - u[f] ** 2))) + 1e-9
                    keep &= unit[:, f] >= u[f] * cosine - spread if u[f] > 0 else unit[:, f] <= u[f] * cosine + spread
                at = np.nonzero(keep)[0]
            else:  # length
                at = slice(0, int(np.searchsorted(-norm, -(b / size) * (1 - SLACK), side="right")))
        ids = cid[at]
        score = _products(q[i], c[at])
        fit = (ids != qid[i]) & (score >= b)
        ids, score = ids[fit], score[fit]
        for j in _best(score, ids, k):
            out.append((int(qid[i]), int(ids[j]), int(score[j])))
    return out


def _numbered(df: DataFrame, parts: int, order: list, rows: int, name: str) -> DataFrame:
    """df, written with its place in the given order, and with a long column `name`: every `rows` rows have one number.

    Rows are dealt by range and sorted; what earlier partitions hold is added to a row's place in its own, so numbers do not depend on
    how many partitions Spark makes."""
    at = F.monotonically_increasing_id()  # partition << 33 | row in it
    dealt = cut(df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).withColumn("__at", at), name)
    sizes = dealt.groupBy(F.shiftright("__at", 33).alias("part")).count().orderBy("part").collect()  # a row for each partition
    before = [sum(r["count"] for r in sizes[:i]) for i in range(len(sizes))]
    starts = df.sparkSession.createDataFrame([(r["part"], n) for r, n in zip(sizes, before, strict=True)], "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__part"))
    return dealt.select(*df.columns, F.floor(place / rows).alias(name))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score.  Both tables come from integer_vectors."""
    spark = candidates.sparkSession
    n, n_queries = candidates.count(), queries.count()
    most = partitions(spark)
    # the longest vectors: block_rows at most, so that this broadcast has a fixed size
    first = spark.sparkContext.broadcast(candidates.orderBy(F.desc("norm2"), "id").limit(block_rows).select("id", "v", "dim").toPandas())

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = first.value
        by_dim = {d: (g["id"].to_numpy(), np.stack(g["v"].to_list()).reshape(len(g), d)) for d, g in top.groupby("dim")}
        for pdf in batches:
            low, need = [], []
            for qid, q, d in zip(pdf["qid"], pdf["q"], pdf["qdim"], strict=True):
                ids, c = by_dim.get(d, (np.zeros(0, int), np.zeros((0, d), int)))
                score = _products(np.asarray(q), c)[ids != qid]
                low.append(float(np.sort(score)[-k]) if len(score) >= k else float("-inf"))
                size = float(np.sqrt((np.asarray(q, np.float64) ** 2).sum()))
                need.append((low[-1] / size * (1 - SLACK)) ** 2 if low[-1] > 0 and size > 0 else 0.0)
            yield pdf.assign(bound=low, need=need)

    asked = queries.select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("dim").alias("qdim")).distinct()
    asked = asked.mapInPandas(bounds, "qid long, q array<long>, qdim int, bound double, need double")
    asked = _numbered(asked, min(most, -(-n_queries // query_rows)), [F.asc("need"), F.asc("qid")], query_rows, "group")
    dealt = _numbered(candidates, min(most, -(-n // block_rows)), [F.desc("norm2"), F.asc("id")], block_rows, "block")

    # blocks by falling norm; a group of queries meets those of the first runs of blocks that reach its least need
    step = max(1, -(-n // (block_rows * most)))  # blocks that are one entry of the table on the driver
    blocks = dealt.groupBy("block").agg(F.max("norm2").alias("top")).withColumn("part", F.floor(F.col("block") / step))
    tops = [(r["part"], r["top"]) for r in blocks.groupBy("part").agg(F.max("top").alias("top")).collect()]  # at most `most` rows and one
    groups = asked.groupBy("group").agg(F.min("need").alias("need"))
    near = F.filter(F.array(*(F.struct(F.lit(p).cast("long").alias("part"), F.lit(t).alias("top")) for p, t in tops)), lambda x: x["top"] >= F.col("need")) if tops else F.array().cast("array<struct<part:long,top:double>>")
    pairs = groups.select("group", "need", F.explode(near).alias("at")).select("group", "need", F.col("at.part").alias("part")).join(blocks, "part").filter("top >= need")
    pairs = cut(pairs.select("group", "block", "top"), "pairs")
    left = dealt.join(pairs.select("group", "block"), "block").select("block", "group", "id", "v", "dim")
    right = asked.join(pairs, "group").filter("need <= top").select("block", "group", "qid", "q", "qdim", "bound")

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, own in c.groupby("dim"):
            asked = q[q["qdim"] == d]
            if len(asked):
                vectors = np.stack(own["v"].to_list()).reshape(len(own), d)
                out += search_block(own["id"].to_numpy(), vectors, asked["qid"].to_numpy(), np.stack(asked["q"].to_list()).reshape(len(asked), d), asked["bound"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
