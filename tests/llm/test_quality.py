import numpy as np
from pyspark.sql import functions as F

from lattica.llm import quality as Q

from .cases import edge_docs, no_docs


def test_against_labels_that_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = Q.score_quality(docs, Q.fit_quality(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    bad, kept_bad, good, kept_good = out.agg(*(F.expr(f"count_if({c})") for c in ("quality = 0", "quality = 0 and keep = 1", "quality = 1", "quality = 1 and keep = 1"))).first()
    assert kept_good >= 0.97 * good and kept_bad <= 0.35 * bad


def test_em_finds_accuracies_of_made_labellers():
    rng = np.random.default_rng(2)
    n, good = 20_000, rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.85, 0.7]
    patterns = np.zeros(n, np.int64)
    for r in right:
        says = np.where(rng.random(n) < r, good, ~good)
        vote = np.where(rng.random(n) < 0.3, 1, np.where(says, 2, 0))
        patterns = patterns * 3 + vote
    u, c = np.unique(patterns, return_counts=True)
    model = Q.fit_labels(u, c.astype(float))
    assert abs(model.good - 0.8) < 0.06
    assert np.argsort(list(model.accuracies().values()))[0] in (5, 7)
    assert ((model.posterior(patterns) > 0.5) == good).mean() > 0.95


def test_edge_rows(spark):
    docs = edge_docs(spark)
    model = Q.fit_quality(docs)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert Q.score_quality(no_docs(spark), model).count() == 0
    assert Q.score_quality(docs, Q.fit_quality(no_docs(spark))).count() == docs.count()


def test_sample_is_bounded_when_half_the_table_is_one_text(spark):
    from lattica.llm.common import distinct_sample

    rows = [(f"text number {i} with words",) for i in range(3000)] + [("the one hot text",)] * 3000
    docs = spark.createDataFrame(rows, "text string")
    for seed in range(4):  # whichever side of the limit the hot text's hash falls on
        got = [r["text"] for r in distinct_sample(docs, "text", 400, seed).collect()]
        assert len(got) == len(set(got)) == 400
    assert distinct_sample(docs, "text", 10_000, 1).count() == 3001


def test_sample_of_nearly_all_texts(spark):
    """A table with somewhat more texts than the limit, up to a fifth: the bound on hashes lies beyond the longs."""
    from lattica.llm.common import distinct_sample

    docs = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for most in (2000, 2500, 2600, 2800, 2950):
        assert distinct_sample(docs, "text", most, 7).distinct().count() == most
    model = Q.fit_quality(docs.withColumnRenamed("text", "body"), text_col="body", train_rows=100)
    assert len(model.weights) == 1 << Q.BITS


def test_em_against_plain_loops():
    rng = np.random.default_rng(4)
    n = len(Q.LABELLERS)
    rows = [[int(x) for x in rng.choice([0, 1, 2], n, p=[0.2, 0.3, 0.5])] for _ in range(200)]
    patterns = np.array([sum(v * 3 ** (n - 1 - j) for j, v in enumerate(r)) for r in rows])
    u, c = np.unique(patterns, return_counts=True)
    model = Q.fit_labels(u, c.astype(float), rounds=25)
    good, chance, prior = 0.85, [[0.6] * n, [0.97] * n], max(2.0, len(rows) * 0.05)
    for _ in range(25):
        post = []
        for r in rows:
            like = []
            for k, share in enumerate((1 - good, good)):
                for j, v in enumerate(r):
                    share *= chance[k][j] if v == 2 else 1 - chance[k][j] if v == 0 else 1.0
                like.append(share)
            post.append(like[1] / sum(like))
        new = []
        for k in (0, 1):
            w = [p if k else 1 - p for p in post]
            new.append([
                min(max((sum(x for x, r in zip(w, rows, strict=True) if r[j] == 2) + prior * (0.6, 0.97)[k]) / (sum(x for x, r in zip(w, rows, strict=True) if r[j] != 1) + prior), 1e-4), 1 - 1e-4)
                for j in range(n)
            ])
        good, chance = (sum(post) + 1) / (len(rows) + 2), new
    assert abs(model.good - good) < 1e-6 and np.allclose(model.chance, chance, atol=1e-6)
