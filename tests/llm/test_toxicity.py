import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import toxicity as X
from lattica.llm.queries import labelled

from .cases import edge_docs, no_docs


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.fit_toxicity(labelled(spark, docs, sf))
    from lattica.llm.common import fold

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = X.score_toxicity(docs, model).join(labels, "doc_id").filter(fold("doc_id", 4) == 2)
    tp, fp, fn = out.agg(*(F.expr(f"count_if(predicted = {p} and toxic = {t})") for p, t in ((1, 1), (1, 0), (0, 1)))).first()
    assert tp / (tp + fn) > 0.85 and tp / (tp + fp) > 0.95, (tp, fp, fn)


def test_pairs_count_where_single_terms_do_not(spark):
    rng = random.Random(2)
    filler = [f"plain{i}" for i in range(30)]
    rows = []
    for i in range(1500):
        a, b = i % 2, i // 2 % 2  # insult, group: toxic only together
        words = [rng.choice(filler) for _ in range(12)] + ["dolt"] * a + ["gnomes"] * b
        rng.shuffle(words)
        rows.append((" ".join(words), int(a and b)))
    model = X.fit_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    index = model.index()
    both, one, other, none = model.score([b"plain1 dolt plain2 gnomes", b"plain1 dolt plain2", b"plain1 gnomes", b"plain1 plain2"], index)
    assert both > 0.8 and max(one, other, none) < 0.2


def test_logits_are_the_pairwise_sum():
    rng = np.random.default_rng(1)
    fm = X.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    own = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    who = np.repeat(np.arange(4), [len(o) for o in own])
    got = fm.logits(4, who, np.array([f for o in own for f in o]))
    for o, x in zip(own, got, strict=True):
        want = 0.3 + sum(fm.weights[i] for i in o) + sum(fm.factors[i] @ fm.factors[j] for i in o for j in o if i < j)
        assert abs(want - x) < 1e-9


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = docs.select("text", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 5, 0).alias("toxic"))
    for model in (X.fit_toxicity(rows), X.fit_toxicity(rows.limit(0)), X.fit_toxicity(rows.withColumn("toxic", F.lit(1)))):
        got = X.score_toxicity(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        empty = {r["score"] for r in got if r["doc_id"] in (3, 4)}
        assert len(empty) == 1
        assert X.score_toxicity(no_docs(spark), model).count() == 0


def test_words_hash_alone_and_do_not_depend_on_the_batch():
    from lattica.llm.hashing import words

    texts = [b"One two, THREE", b"", b"two\nthree one", b"x" * 70_000 + b" two"]
    who, value = words(texts)
    assert who.tolist() == [0, 0, 0, 2, 2, 2, 3, 3]
    assert value[1] == value[3] == value[7] and value[2] == value[4] and value[0] == value[5]
    assert words([b"two"])[1][0] == value[1]


def test_sample_is_bounded_when_half_the_rows_are_one_text(spark):
    rows = [(f"text number {i}", i % 2) for i in range(2000)] + [("the one hot text", 1)] * 2000
    taught = []
    keep, X.cut = X.cut, lambda d, name: taught.append(keep(d, name)) or taught[-1]
    try:
        X.fit_toxicity(spark.createDataFrame(rows, "text string, toxic int"), train_rows=300)
    finally:
        X.cut = keep
    assert taught[0].count() == 300 and taught[0].distinct().count() == 300


# ---------------------------------------------------------------- plain versions, in loops


def plain_terms(text):
    """Buckets of the words and of the beginnings of longer words of a text."""
    out, mask = set(), (1 << 64) - 1

    def bucket(b, salt):
        v = sum((c + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(b)) & mask ^ salt
        v ^= v >> 29
        v = v * 0x9E3779B97F4A7C15 & mask
        return (v ^ v >> 32) >> 64 - X.BITS

    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for word in bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in lower).split():
        out.add(bucket(word, 0))
        out |= {bucket(word[:n], n * 0x2545F4914F6CDD1D & mask) for n in X.PREFIXES if len(word) > n}
    return out


def plain_selection(rows, terms, least_docs):
    size = [sum(y == k for _, y in rows) for k in (0, 1)]
    seen = {}
    for text, y in rows:
        for b in plain_terms(text):
            seen.setdefault(b, [0, 0])[y] += 1
    chi = {}
    for b, (n0, n1) in seen.items():
        if n0 + n1 >= least_docs:
            want = (n0 + n1) * size[1] / sum(size)
            chi[b] = (n1 - want) ** 2 / want + (n0 - (n0 + n1 - want)) ** 2 / (n0 + n1 - want)
    return sorted(b for b in sorted(chi, key=lambda b: (-chi[b], b))[:terms] if chi[b] > 15)


def plain_logit(own, bias, w, v):
    return bias + sum(w[i] for i in own) + sum(v[i][f] * v[j][f] for i in own for j in own if i < j for f in range(len(v[i])))


def plain_training(rows, size, rank, epochs, rate=0.05, decay=3e-4):
    """rows: (features, label).  Adam on the mean log loss, every derivative written out."""
    n, base = len(rows), (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    p = [math.log(base / (1 - base)), *[0.0] * size, *np.random.default_rng(5).normal(0, 0.05, size * rank).tolist()]
    m, s = [0.0] * len(p), [0.0] * len(p)
    at = lambda i, f: 1 + size + i * rank + f
    for step in range(1, epochs + 1):
        g = [0.0, *(decay * x / 10 for x in p[1:])]
        for own, y in rows:
            z = plain_logit(own, p[0], p[1 : 1 + size], [[p[at(i, f)] for f in range(rank)] for i in range(size)])
            e = (1 / (1 + math.exp(-z)) - y) / n
            g[0] += e
            for i in own:
                g[1 + i] += e
                for f in range(rank):
                    g[at(i, f)] += e * sum(p[at(j, f)] for j in own if j != i)
        for k in range(len(p)):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (math.sqrt(s[k] / (1 - 0.999**step)) + 1e-9)
    return p


def small_corpus(seed):
    rng = random.Random(seed)
    filler = [f"{a}{b}" for a in ("plain", "words", "étude", "go") for b in ("", "s", "ing", "fully")]
    rows = []
    for i in range(160):
        words = [rng.choice(filler) for _ in range(rng.randint(2, 9))]
        toxic = int(rng.random() < 0.4)
        words += rng.choices(["dolts", "Doltish", "gnomes"], k=2) if toxic or rng.random() < 0.1 else []
        rng.shuffle(words)
        rows.append((f"{' '.join(words)}, n{i}", toxic))
    return rows


def test_selection_against_plain_loops(spark):
    rows = small_corpus(3)
    for terms in (2048, 3):
        model = X.fit_toxicity(spark.createDataFrame(rows + rows[:40] + [("left out", None)], "text string, toxic int"), terms=terms)
        assert model.buckets.tolist() == plain_selection(rows, terms, 4) and 0 < len(model.buckets) <= terms


def test_training_steps_against_plain_loops():
    rng = random.Random(8)
    rows = [(sorted(rng.sample(range(7), rng.randint(0, 5))), rng.randint(0, 1)) for _ in range(25)]
    who = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    fm = X.train(np.arange(7), len(rows), who, np.array([i for f, _ in rows for i in f]), np.array([y for _, y in rows], float), rank=3, epochs=6)
    want = plain_training(rows, 7, 3, 6)
    assert np.allclose([fm.bias, *fm.weights, *fm.factors.ravel()], want, rtol=1e-9, atol=1e-12)


def test_query_against_plain_loops(spark, tmp_path):
    """Labels of the learning fold, terms, all training steps and scores of the query on a small table."""
    from lattica.llm import queries as Q

    texts = [t for t, _ in small_corpus(5)]
    toxic = dict(enumerate(y for _, y in small_corpus(5)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in toxic.items() if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learned = [(texts[i], y) for i, y in toxic.items() if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    buckets = plain_selection(learned, 2048, 4)
    place = {b: k for k, b in enumerate(buckets)}
    own = lambda t: sorted(place[b] for b in plain_terms(t) if b in place)
    size = len(buckets)
    p = plain_training([(own(t), y) for t, y in learned], size, 6, 250)
    v = [[p[1 + size + i * 6 + f] for f in range(6)] for i in range(size)]
    got = {r["doc_id"]: r for r in Q.op5_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and size > 3
    for i, t in enumerate(texts):
        score = 1 / (1 + math.exp(-plain_logit(own(t), p[0], p[1 : 1 + size], v)))
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
