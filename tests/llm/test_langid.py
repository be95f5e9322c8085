import random

from pyspark.sql import functions as F

from lattica.llm import langid as L
from lattica.llm.common import fold

from .cases import edge_docs, no_docs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit_languages(docs.filter(fold("doc_id", 3) != 1))
    out = L.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(fold("doc_id", 3) == 1)
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 300 and right >= 0.97 * n


def test_mixtures_recover_their_proportions(spark):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(make("aeioun", 80), "x") for _ in range(30)] + [(make("bcdfgh", 80), "y") for _ in range(30)] + [(make("jklmpq", 80), "z") for _ in range(30)]
    model = L.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    both = (make("aeioun", 300) + " " + make("bcdfgh", 100)).encode()
    found = model.mixture(both)
    assert [lang for lang, _ in found] == ["x", "y"] and abs(found[0][1] - 0.75) < 0.05
    assert model.mixture(make("jklmpq", 50).encode()) == [("z", 1.0)]


def test_labels_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit_languages(docs)
    a = L.identify_languages(docs, model).collect()
    other = docs.withColumns({"lang": F.lit("q"), "source": F.lit(None).cast("string")})
    assert sorted(a) == sorted(L.identify_languages(other, model).collect())


def test_edge_rows(spark):
    docs = edge_docs(spark)
    model = L.fit_languages(docs)
    assert set(model.languages) == {"en", "fr"}
    got = {r["doc_id"]: r for r in L.identify_languages(docs, model).filter("doc_id is not null").collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 6)] == ["und"] * 3 and got[3]["score"] == 0 and got[4]["languages"] == []
    assert got[1]["lang_pred"] in ("en", "fr") and 0 < got[1]["score"] <= 1
    assert L.identify_languages(no_docs(spark), model).count() == 0
    nothing = L.fit_languages(no_docs(spark))
    assert {r["lang_pred"] for r in L.identify_languages(docs, nothing).collect()} == {"und"}


def test_no_language_is_lost_to_the_bound(spark):
    """A language of one text and one whose rows are all copies are learned beside 300 others and a large one."""
    rows = [("large " + str(i), "big") for i in range(3000)] + [("solus unicus", "rare")] + [("copia copiarum", "copies")] * 500
    rows += [(f"{chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = L.fit_languages(docs, language_rows=50)
    assert len(model.languages) == 303
    found = L.language_mixture(F.col("text"), model, spark)
    got = {r["lang"]: r["p"] for r in docs.filter("lang in ('rare', 'copies')").select("lang", found["lang"].alias("p")).distinct().collect()}
    assert got == {"rare": "rare", "copies": "copies"}
    try:
        L.fit_languages(docs, most_languages=300)
    except ValueError:
        pass
    else:
        raise AssertionError("too many labels must be an error")


def plain_mixture(text, texts_of, bits=15, rounds=12, penalty=6.0):
    """The method by plain loops: EM over trigram likelihoods, and languages by falling share while the penalised likelihood rises."""
    import math

    from lattica.llm.hashing import trigrams

    names = sorted(texts_of)
    p = []
    for name in names:
        counts = {}
        for t in texts_of[name]:
            for b in trigrams(t.encode(), bits).tolist():
                counts[b] = counts.get(b, 0) + 1
        total = sum(counts.values()) + 0.5 * (1 << bits)
        p.append(lambda b, counts=counts, total=total: (counts.get(b, 0) + 0.5) / total)
    grams = trigrams(text.encode(), bits).tolist()

    def em(chosen, share):
        for _ in range(rounds):
            new = [0.0] * len(chosen)
            for b in grams:
                parts = [s * p[i](b) for i, s in zip(chosen, share, strict=True)]
                for j, x in enumerate(parts):
                    new[j] += x / sum(parts) / len(grams)
            share = new
        return share, sum(math.log(sum(s * p[i](b) for i, s in zip(chosen, share, strict=True))) for b in grams)

    share, _ = em(list(range(len(names))), [1 / len(names)] * len(names))
    single = [sum(math.log(q(b)) for b in grams) for q in p]
    first = single.index(max(single))
    order = [first] + [i for i in sorted(range(len(names)), key=lambda i: -share[i]) if i != first]
    cost = penalty * math.log(len(grams) + 1)
    best, kept, shares = single[first] - cost, [first], [1.0]
    for n in range(2, len(order) + 1):
        if share[order[n - 1]] < 0.01:
            break
        start = [max(share[i], 0.01) for i in order[:n]]
        got, value = em(order[:n], [s / sum(start) for s in start])
        if value - n * cost <= best:
            break
        best, kept, shares = value - n * cost, order[:n], got
    return sorted(((names[i], s / sum(shares)) for i, s in zip(kept, shares, strict=True)), key=lambda x: (-x[1], x[0]))


def test_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null and text is not null")
    model = L.fit_languages(docs)
    texts_of = {}
    for r in docs.collect():
        texts_of.setdefault(r["lang"], []).append(r["text"])
    short = sorted((r["text"] for r in docs.collect() if 30 < len(r["text"]) < 400), key=len)[:12]
    mixed = [short[0] + " " + min(texts_of[name], key=len) for name in sorted(texts_of)]
    for t in short + mixed:
        got, want = model.mixture(t.encode()), plain_mixture(t, texts_of)
        assert [a for a, _ in got] == [a for a, _ in want]
        assert all(abs(x - y) < 1e-3 for (_, x), (_, y) in zip(got, want, strict=True))
