import math

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing as M

from .cases import edge_docs, no_docs


def corpus(spark, sizes):
    rows = [(1000 * s + i, "word " * (8 + i % 5), f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def mixed(docs, **more):
    out, name = M.mix(docs, **more)
    return out.select(*docs.columns, f"{name}.*")


def test_repetition_limit_and_weights(spark):
    docs = corpus(spark, [900, 300, 100, 40])
    own = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum(M.document_tokens(F.col("text"))).alias("t")).collect()}
    got = mixed(docs, repeats=3.0).groupBy("source").agg(F.sum("tokens").alias("t"), F.countDistinct("doc_id").alias("d"), F.first("weight").alias("w")).collect()
    times = {r["source"]: r["t"] / own[r["source"]] for r in got}
    assert sum(r["d"] for r in got) == docs.count()  # every document at least once
    assert abs(times["s0"] - 1) < 1e-9 and 2.8 <= times["s3"] <= 3.0 + 1e-9
    total = sum(r["t"] for r in got)
    assert all(abs(r["t"] / total - r["w"]) < 0.01 for r in got) and abs(sum(r["w"] for r in got) - 1) < 1e-9
    # shares raised to one exponent: log weights are linear in log shares
    x, y = [math.log(own[r["source"]]) for r in got], [math.log(r["w"]) for r in got]
    slopes = [(y[i] - y[0]) / (x[i] - x[0]) for i in range(1, 4)]
    assert max(slopes) - min(slopes) < 1e-6


def test_entropy_target(spark):
    docs = corpus(spark, [900, 300, 100, 40])
    for target in (1.0, 1.2, math.log(4)):
        w = [r["w"] for r in mixed(docs, repeats=None, entropy=target).groupBy("source").agg(F.first("weight").alias("w")).collect()]
        assert abs(-sum(p * math.log(p) for p in w) - target) < 1e-4


def test_entropy_out_of_reach_is_an_error(spark):
    docs = corpus(spark, [900, 300, 100, 40])
    for target in (0.2, 2.0):
        with pytest.raises(ValueError, match="entropy"):
            M.mix(docs, repeats=None, entropy=target)


def test_the_cut_is_the_one_of_a_plain_sum(spark):
    """Documents of the cut block by falling room: those whose keys, sorted, fit into what is left."""
    docs = corpus(spark, [3000, 700])
    key, tokens = M.document_key("doc_id", "text"), M.document_tokens(F.col("text"))
    for budget in (3100, 5200, 9001):
        plan = {(r["source"], r["block"]): r for r in M.mix_plan(docs, F.col("source"), key, tokens, repeats=1.2, budget=budget).collect()}
        rows = docs.select("source", key.alias("key"), tokens.alias("n")).collect()
        own = {s: sum(r["n"] for r in rows if r["source"] == s) for s in ("s0", "s1")}
        spent = {s: sum(r["n"] * plan[s, r["key"] % M.BLOCKS]["epochs"] for r in rows if r["source"] == s) for s in own}
        for (s, b), p in plan.items():
            room, whole = p["quota"] - spent[s], p["epochs"]
            if p["cut"] is not None:
                inside = sorted((r["key"], r["n"]) for r in rows if r["source"] == s and r["key"] % M.BLOCKS == b)
                total, cut = 0, None
                for k, n in inside:
                    total += n
                    if total > room:
                        break
                    cut = k
                assert p["cut"] == cut and whole >= 0


def test_budget_is_spent_by_whole_and_cut_blocks(spark):
    docs = corpus(spark, [900, 300])
    for budget in (500, 2000, 9000):
        rows = mixed(docs, repeats=1.5, budget=budget)
        spent = {r["source"]: (r["t"], r["w"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w")).collect()}
        for t, w in spent.values():
            assert budget * w - 4 - 4 * 4 <= t <= budget * w + 1
        again = rows.groupBy("doc_id").count().agg(F.max("count")).first()[0]
        assert again <= math.ceil(1.5 * max(budget / 4000, 1)) + 1


def test_epochs_come_in_other_permutations(spark):
    rows = mixed(corpus(spark, [2000, 20]), repeats=3.0).filter("source = 's1'").collect()
    order = {e: [r["block"] for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: r["turn"])] for e in (1, 2)}
    blocks = {e: list(dict.fromkeys(o)) for e, o in order.items()}
    # documents of a block stand together, each block has one turn in an epoch, and the second epoch's turns are other ones
    assert all(sum(a != b for a, b in zip(o, o[1:], strict=False)) == len(set(o)) - 1 for o in order.values())
    assert blocks[1] != blocks[2] and set(blocks[2]) <= set(blocks[1])


def test_same_result_again(spark):
    docs = corpus(spark, [200, 50])
    a, b = mixed(docs, budget=1500), mixed(docs.repartition(7), budget=1500)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_edge_rows(spark):
    docs = edge_docs(spark)
    out, name = M.mix(docs)
    assert out.columns == [*docs.columns, name]
    assert out.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    empty, _ = M.mix(no_docs(spark))
    assert empty.count() == 0
