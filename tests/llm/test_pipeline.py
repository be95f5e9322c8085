import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from .cases import edge_docs, no_docs
from .test_simhash import jaccard, plain_groups


def staged(spark, docs, folder, sf_dir):
    out = {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        out[name], docs = spark.read.parquet(f"{folder}/{i}"), spark.read.parquet(f"{folder}/{i}")
    return out


def with_labels(spark, folder, rows=()):
    spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = staged(spark, docs, tmp_path / "o", sf)
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in out.items()}
    assert ids["near duplicates"] <= ids["toxicity"] and ids["secrets"] == ids["near duplicates"] == ids["mixing"] == ids["packing"]
    # exact copies: the one with the smallest id stays
    left = out["toxicity"].groupBy("text").agg(F.min("doc_id").alias("i"), F.count("*").alias("n")).filter("n > 1").collect()
    texts = out["near duplicates"].groupBy("text").count().filter("count > 1").count()
    assert texts == 0 and left
    assert out["secrets"].filter(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0
    assert out["secrets"].filter("n_chars <> length(text)").count() == 0
    n = out["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert n <= 2
    pieces = out["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    times = {r["doc_id"]: r["count"] for r in out["mixing"].groupBy("doc_id").count().collect()}
    assert all(r["n"] == r["t"] * times[r["doc_id"]] for r in pieces.collect())


def test_edge_rows_and_empty_tables(spark, tmp_path):
    sf = with_labels(spark, tmp_path / "l", [(1, 1, 0), (2, None, None), (None, 0, 1), (5, 0, 0), (1, 0, 0), (3, 1, 0), (4, 1, 0), (7, 1, 0), (7, 1, 0)])
    docs = edge_docs(spark)
    out = staged(spark, docs, tmp_path / "a", sf)
    assert all(d.columns == docs.columns for n, d in out.items() if n != "packing")
    kept = [r[0] for r in out["near duplicates"].select("doc_id").collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 2
    nothing = staged(spark, no_docs(spark), tmp_path / "b", with_labels(spark, tmp_path / "m"))
    assert all(d.count() == 0 for d in nothing.values())


def test_near_duplicates_against_all_pairs(spark, sf, tmp_path):
    """What stays is the document with the least id of each single-link group of index 0.8 or more, and all of its columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    group = dict(plain_groups([(i, r["text"] or "") for i, r in rows.items()], lambda a, b: jaccard(a, b) >= 0.8 or not a.split() and not b.split()))
    got = {r["doc_id"]: r for r in P.one_of_each(spark, docs, sf).collect()}
    assert set(got) == set(group.values()) and all(got[i] == rows[i] for i in got)


def test_near_copies_go_and_clean_documents_stay(spark, sf):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, copies = [], set()
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        rows.append((d, " ".join(text) + (f" {passage}" if d % 3 == 0 else ""), "en", "s", 0))
        if d % 5 == 0:
            near = rows[-1][1].split()
            for _ in range(max(1, len(near) // 70)):
                near[rng.randrange(len(near))] = "changed"
            if jaccard(" ".join(near), rows[-1][1]) >= 0.8:
                rows.append((1000 + d, " ".join(near), "en", "s", 0))
                copies.add(1000 + d)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(copies) > 20 and {r["doc_id"] for r in P.one_of_each(spark, docs, sf).collect()} == {i for i, *_ in rows} - copies


def test_an_id_of_two_groups_loses_neither(spark, sf):
    """Two texts under one id, each with its own near copies: a document of each group stays."""
    a, b = ([f"{x}{i}" for i in range(80)] for x in "ab")
    near = lambda t: " ".join([*t[:40], "x", *t[41:]])
    rows = [(1, " ".join(a), "en", "s", 0), (2, near(a), "en", "s", 0), (1, " ".join(b), "en", "s", 0), (3, near(b), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"][0]) for r in P.one_of_each(spark, docs, sf).collect()) == [(1, "a"), (1, "b")]
