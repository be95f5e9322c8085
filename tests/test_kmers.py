import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import tables as T

BACK = str.maketrans("ACGT", "TGCA")


def other_strand(s):
    return s.translate(BACK)[::-1]


def canonical(s, k):
    return {min(s[i : i + k], other_strand(s[i : i + k])) for i in range(len(s) - k + 1)}


def all_pairs(rows, k, least):
    first = {}
    for i, s in sorted(rows):
        first.setdefault(s, i)
    sets = {i: canonical(s, k) for s, i in first.items() if len(s) >= k}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and (c := len(sets[a] & sets[b])) and c / len(sets[a] | sets[b]) >= least:
                out[a, b] = c / len(sets[a] | sets[b])
    return out


def families(seed, n, size):
    """Families of near-equal sequences, some read from the other strand."""
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        base = rng.choices("ACGT", k=90)
        for _ in range(size):
            s = base[: rng.choice([90, 80, 60])]
            for _ in range(rng.randint(0, 4)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
            rows.append((len(rows), "".join(s) if rng.random() < 0.6 else other_strand("".join(s))))
    return [*rows, (len(rows), "ACG"), (len(rows) + 1, rows[0][1])]


@pytest.mark.parametrize("least,block", [(0.1, 512), (0.5, 8), (0.8, 3), (0.95, 8)])
def test_similar_pairs_on_both_strands(spark, least, block):
    rows = families(int(least * 100), 4, 25)
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {(r["a"], r["b"]): r["sim"] for r in T.kmer_similarity_join(df, "id", "seq", 9, least, block).collect()}
    want = all_pairs(rows, 9, least)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want) and want


def test_reverse_complement_is_the_same_sequence(spark):
    s = families(1, 1, 1)[0][1]
    got = T.kmer_similarity_join(spark.createDataFrame([(1, s), (2, other_strand(s))], "id long, seq string"), "id", "seq", 8, 0.9).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1.0)]


def test_blocks_bound_the_keys_of_the_join(spark, monkeypatch):
    """A thousand near-equal sequences share their k-mers; no key of the join has more than a few rows of a block."""
    rng = random.Random(2)
    base = rng.choices("ACGT", k=40)
    rows = []
    for i in range(1000):
        s = list(base)
        s[rng.randrange(40)] = "N"
        s[rng.randrange(40)] = rng.choice("ACGT")
        rows.append((i, "".join(s)))
    seen, real = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, name: seen.append((name, out := real(df, name))) or out)
    T.kmer_similarity_join(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", 12, 0.5, 50)
    prefixes = dict(seen)["prefixes"]
    most = prefixes.groupBy("kmer", "own").count().agg(F.max("count")).first()[0]
    assert prefixes.groupBy("kmer").count().agg(F.max("count")).first()[0] > 200 and most < 100


@pytest.mark.parametrize("most_bits", [T.BLOOM_BITS, 64])
def test_recruits_with_and_without_the_filter(spark, most_bits):
    rows = families(9, 6, 12)
    refs = rows[:5]
    known = set().union(*(canonical(s, 9) for _, s in refs))
    want = {i: len(canonical(s, 9) & known) for i, s in rows if len(canonical(s, 9) & known) >= 4}
    df, r = spark.createDataFrame([*rows, (900, None), (901, "")], "id long, seq string"), spark.createDataFrame(refs, "id long, seq string")
    out = T.recruit_reads(df, r, "id", "seq", 9, 4, most_bits)
    assert {x["id"]: x["n"] for x in out.collect()} == want and 0 < len(want) < len(rows)
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert ("ArrowEvalPython" in plan) == (most_bits > 64)
    if most_bits > 64:  # the filter is read before k-mers are shuffled: an exchange by k-mer stands above it
        assert plan.rindex("ArrowEvalPython") > plan.index("Exchange hashpartitioning(kmer" if "hashpartitioning(kmer" in plan else "HashAggregate")


@pytest.mark.parametrize("most_bits,join", [(T.BLOOM_BITS, False), (20_000, True)])
def test_few_reference_kmers_are_counted_without_rows(spark, most_bits, join):
    """where the references' k-mers fit, no k-mer of a read is a row; where only their Bloom filter does, the join is exact as ever."""
    rows = families(9, 6, 12)
    refs = rows[::3]
    known = set().union(*(canonical(s, 9) for _, s in refs))
    assert 10 * len(known) < 20_000 < 64 * len(known)
    want = {i: len(canonical(s, 9) & known) for i, s in rows if len(canonical(s, 9) & known) >= 4}
    df, r = spark.createDataFrame([*rows, (900, None), (901, "")], "id long, seq string"), spark.createDataFrame(refs, "id long, seq string")
    out = T.recruit_reads(df, r, "id", "seq", 9, 4, most_bits)
    assert {x["id"]: x["n"] for x in out.collect()} == want
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert ("Join" in plan) == ("Generate" in plan) == join and "ArrowEvalPython" in plan


def test_a_read_from_the_other_strand_is_recruited(spark):
    ref = families(4, 1, 1)[0][1].replace("N", "A")
    got = T.recruit_reads(spark.createDataFrame([(7, other_strand(ref)[5:60])], "id long, seq string"), spark.createDataFrame([(1, ref)], "id long, seq string"), "id", "seq", 8, 3).collect()
    assert [(r["id"], r["n"]) for r in got] == [(7, len(canonical(other_strand(ref)[5:60], 8)))]
    nothing = spark.createDataFrame([], "id long, seq string")
    assert T.recruit_reads(spark.createDataFrame([(7, ref)], "id long, seq string"), nothing, "id", "seq", 8, 1).count() == 0


def published(a, b):
    """Mann-Whitney with tie-corrected variance and continuity correction, by the formulas of the textbook."""
    both = sorted(a + b)
    rank = {v: both.index(v) + (both.count(v) + 1) / 2 for v in set(both)}
    n1, n2, n = len(a), len(b), len(both)
    u = sum(rank[v] for v in a) - n1 * (n1 + 1) / 2
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if not sigma:
        return n1, n2, u, 0.0, 1.0
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / sigma
    return n1, n2, u, math.copysign(z, u - n1 * n2 / 2) if z else 0.0, math.erfc(z / math.sqrt(2))


@pytest.mark.parametrize("a,b", [([1, 1, 1, 2, 2, 3] * 5, [1, 2, 2, 2, 3, 3, 3] * 4), ([1.5, 2.5, 9.0], [0.5, 1.0, 3.0, 4.0]), ([7] * 30, [7] * 20), (list(range(40)), [x + 3 for x in range(50)]), ([0] * 90 + [1] * 2, [0] * 60 + [1] * 9), ([1, 2], [1, 2])])
def test_rank_test_on_tied_samples(spark, a, b):
    of = lambda v: spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = tuple(T.mann_whitney_u(of(a), of(b), "v").first())
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, published(a, b), strict=True))


def test_rank_test_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert T.mann_whitney_u(empty, empty, "v").first()["n1"] == 0
    assert T.mann_whitney_u(spark.createDataFrame([(1.0,)], "v double"), empty, "v").first()["p"] is None


@pytest.mark.parametrize("least,blocks", [(0.1, 1), (0.1, 5), (0.5, 3), (0.9, 2)])
def test_blocks_count_what_all_pairs_have(spark, monkeypatch, least, blocks):
    """where k-mers are shared by nearly everything, pairs are counted in blocks, and no candidate is a row."""
    rng = random.Random(blocks)
    rows = [*families(int(least * 50) + blocks, 6, 15), *((1000 + i, "".join(rng.choices("ACGTNacgté", k=rng.choice([5, 6, 40, 70])))) for i in range(60)), (2000, "A" * 50), (2001, "T" * 30), (2002, None)]
    seen, real = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, name: seen.append(name) or real(df, name))
    monkeypatch.setattr(T, "FEWEST_BLOCKS", blocks)
    out = T.kmer_similarity_join(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", 4, least, few=0)
    got = [(r["a"], r["b"], r["sim"]) for r in out.collect()]
    want = all_pairs([r for r in rows if r[1]], 4, least)
    assert len(got) == len(want) and want and all(abs(want[a, b] - sim) < 1e-12 for a, b, sim in got)
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "prefixes" not in seen and "Join" not in plan


def test_clusters_read_their_classes_where_they_are_written(spark, sf):
    """the classes of equal sequences are made once, not again from the documents for the result."""
    from lattica.plans import registry

    out = registry.queries()["similarity_cluster"](spark, sf)
    assert not any("documents" in f for f in out.inputFiles()) and any("lattica-classes" in f for f in out.inputFiles())
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("least,step,together,bytes_", [(0.1, 100, 1, 1 << 28), (0.3, 1000, 500, 1 << 16), (0.6, 1 << 20, 1 << 16, 1 << 15)])
def test_blocks_made_in_steps_count_what_all_pairs_have(spark, monkeypatch, least, step, together, bytes_):
    """whatever the steps in which a block's lists are made and asked, and however small blocks are, pairs are those of all pairs."""
    rng = random.Random(step)
    rows = [*families(7, 5, 14), *((1000 + i, "".join(rng.choices("ACGTNacg\u00e9", k=rng.choice([5, 9, 60])))) for i in range(40)), (2000, "A" * 300), (2001, "T" * 30)]
    want = all_pairs(rows, 5, least)
    for name, value in (("STEP_LETTERS", step), ("TOGETHER", together), ("BLOCK_BYTES", bytes_), ("FEWEST_BLOCKS", 2)):
        monkeypatch.setattr(T, name, value)
    one = sorted({s: i for i, s in sorted(rows, reverse=True)}.items(), key=lambda x: x[1])
    one = [(i, s) for s, i in one if len(s) >= 5]
    half = len(one) // 2
    frame = lambda rows, pair, role: pd.DataFrame({"pair": pair, "role": role, "key": [i for i, _ in rows], "seq": [s for _, s in rows]})
    dealt = [frame(one[:half], 0, 2), frame(one[half : half + 3], 1, 1), frame(one[half + 3 :], 1, 1), frame(one[:half], 1, 0), frame(one[half:], 2, 2), frame(one, 4, 0)]
    got = pd.concat(T._pairs_of_blocks(iter([pd.concat(dealt[:2]), pd.concat(dealt[2:])]), 5, least))
    of = lambda found: {(min(a, b), max(a, b)): s for a, b, s in found.itertuples(index=False)}
    assert len(got) == len(want) == len(of(got)) and all(abs(of(got)[p] - want[p]) < 1e-12 for p in want) and want
    found = T.kmer_similarity_join(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", 5, least, few=0).collect()
    assert {(r["a"], r["b"]) for r in found} == set(want) and len(found) == len(want)


def test_a_block_takes_little_more_than_its_lists(monkeypatch):
    """sequences that ask are not held, and hashes live for a step; all hashes of both blocks at once were 53 bytes a letter of the block that is held."""
    rng = np.random.default_rng(5)

    def batches(n, role):
        for at in range(0, n, 1000):
            letters = rng.choice(list("ACGT"), (1000, 96))
            yield pd.DataFrame({"pair": 1, "role": role, "key": np.arange(at, at + 1000), "seq": ["".join(x) for x in letters.tolist()]})

    monkeypatch.setattr(T, "STEP_LETTERS", 1 << 15)
    held = list(batches(10_000, 1))
    tracemalloc.start()
    list(T._pairs_of_blocks(itertools.chain(held, batches(5_000, 0)), 8, 0.1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25 * 10_000 * 96


def test_blocks_grow_in_number_with_letters_not_bytes():
    """few distinct k-mers, large blocks; no number of k-mers takes more than BLOCK_BYTES."""
    assert T._block_letters(200_000) > 20_000_000
    for distinct in (0, 10**4, 10**6, 10**7, 10**12):
        letters = T._block_letters(distinct)
        assert 0 < letters * (10 + 16 * min(distinct, T.STEP_LETTERS) / T.STEP_LETTERS) + 28 * min(distinct, letters) <= T.BLOCK_BYTES * 1.001
