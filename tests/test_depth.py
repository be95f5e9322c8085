import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import depth as D
from lattica.operators import tables as T

ALN = "ref_id string, pos int, cigar string"


def made_alignments(rng, refs, n):
    return [(r := rng.choice(sorted(refs)), rng.randint(1, refs[r]), f"{rng.randint(0, 9)}S{rng.randint(1, 20)}={rng.randint(1, 9)}I{rng.randint(1, 40)}M") for _ in range(n)]


def covered(refs, alns):
    depth = {r: [0] * n for r, n in refs.items()}
    for r, pos, cigar in alns:
        m = sum(int(n) for n, op in re.findall(r"(\d+)([SIM=])", cigar) if op in "M=")
        for p in range(pos, min(pos + m, refs[r] + 1)):
            depth[r][p - 1] += 1
    return depth


@pytest.mark.parametrize("tile", [7, 100, 100_000])
def test_depth_at_every_tile(spark, tile):
    rng = random.Random(tile)
    refs = {"a": 300, "b": 1, "c": 99, "d": 100, "e": 101, "none": 50}
    alns = made_alignments(rng, {k: v for k, v in refs.items() if k != "none"}, 200) + [("a", 1, "300M"), ("a", 400, "1S5=1I5M")]
    want = covered(refs, alns)
    df, lengths = spark.createDataFrame([*alns, ("a", 5, "*"), ("a", 5, None)], ALN), spark.createDataFrame(list(refs.items()), "ref_id string, ref_len int")
    got = {(r["ref_id"], r["pos"]): r["depth"] for r in D.depth_by_base(df, lengths, tile).collect()}
    assert got == {(r, i + 1): d for r, ds in want.items() for i, d in enumerate(ds)}


def test_long_reference_is_many_tasks(spark):
    n = 10_000_000
    alns = spark.range(20_000).select(F.lit("chr").alias("ref_id"), (F.col("id") * 499 + 1).cast("int").alias("pos"), F.lit("600M").alias("cigar"))
    refs = spark.createDataFrame([("chr", n)], "ref_id string, ref_len int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = D.depth_runs(alns, refs)
        assert runs.select(F.spark_partition_id()).distinct().count() == 4
        got = runs.agg(F.sum(F.col("end") - F.col("start") + 1), F.sum((F.col("end") - F.col("start") + 1) * F.col("depth"))).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert tuple(got) == (n, sum(min(600, n - i * 499) for i in range(20_000)))


def loop_mean(depths, ends, share):
    inner = depths[ends : len(depths) - ends]
    k = round(len(inner) * share / 100)
    low, high = (sorted(inner)[k - 1], sorted(inner)[-k]) if k else (None, None)
    lows = highs = 0
    kept = []
    for d in inner:
        is_low, is_high = k and d <= low, k and d >= high
        if (is_low and lows < k) or (is_high and highs < k):
            lows, highs = lows + bool(is_low), highs + bool(is_high)
        else:
            kept.append(d)
    return low, high, len(kept), ((sum(kept) * 200 + len(kept)) // (2 * len(kept))) / 100 if kept else None


@pytest.mark.parametrize("tile,share", [(7, 25), (50, 10), (100_000, 25), (13, 50), (20, 0)])
def test_trimmed_mean_against_a_loop(spark, tile, share):
    rng = random.Random(tile)
    refs = {f"r{i}": [rng.randint(0, top) for _ in range(rng.choice([21, 60, 200]))] for i, top in enumerate([0, 1, 2, 3, 9, 50, 1000] * 2)}
    rows = [(r, i + 1, d) for r, ds in refs.items() for i, d in enumerate(ds)]
    df, lengths = spark.createDataFrame(rows, "ref_id string, pos int, depth long"), spark.createDataFrame([(r, len(d)) for r, d in refs.items()], "ref_id string, ref_len int")
    got = {r["ref_id"]: (r["low_cut"], r["high_cut"], r["counted"], r["mean_depth"]) for r in D.trimmed_mean_depth(df, lengths, 10, share, tile).collect()}
    assert got == {r: loop_mean(d, 10, share) for r, d in refs.items()}


def test_trimmed_mean_of_runs_is_that_of_positions(spark):
    rng = random.Random(1)
    refs = {"a": 900, "b": 400}
    df, lengths = spark.createDataFrame(made_alignments(rng, refs, 300), ALN), spark.createDataFrame(list(refs.items()), "ref_id string, ref_len int")
    one = D.trimmed_mean_depth(D.depth_runs(df, lengths, 64), lengths, 20, 25, 64).collect()
    assert sorted(one) == sorted(D.trimmed_mean_depth(D.depth_by_base(df, lengths), lengths, 20, 25).collect()) and len(one) == 2


@pytest.mark.parametrize("tile", [1000, 3333, 100_000])
def test_gc_windows_at_their_defaults(spark, tile):
    """Contigs of ten thousand bases and more, windows of 100, ends of 500."""
    rng = random.Random(tile)
    seqs = [(g, f"{g}{i}", "".join(rng.choices("ACGTNacgt", [5, 5, 5, 5, 0.5, 1, 1, 1, 1], k=n))) for g, i, n in (("g", 0, 10_000), ("g", 1, 12_345), ("h", 0, 11_000), ("h", 1, 9_999))]
    depth = [(r, p, rng.randint(0, 30)) for _, r, s in seqs for p in range(1, len(s) + 1) if rng.random() < 0.9]
    mask = [("g0", 3000, 3300), ("h0", 990, 1010), ("h0", 7000, 7000)]
    at, hidden = {(r, p): d for r, p, d in depth}, {(c, p) for c, a, b in mask for p in range(a, b + 1)}
    want = {}
    for g, r, s in seqs:
        if len(s) < 10_000:
            continue
        up, deep = s.upper(), [at.get((r, p), 0) for p in range(1, len(s) + 1)]
        for i in range(500, len(s) - 500 - 99):
            if up[i : i + 100].count("N") <= 4 and (r, i + 1) not in hidden and (r, i + 100) not in hidden:
                k = want.setdefault((g, up[i : i + 100].count("G") + up[i : i + 100].count("C")), [0, 0])
                k[0] += sum(deep[i : i + 100])
                k[1] += 1
    got = D.gc_bias_profile(spark.createDataFrame(depth, "ref_id string, pos int, depth int"), spark.createDataFrame(seqs, "genome string, ref_id string, seq string"), tile=tile, mask=spark.createDataFrame(mask, "contig string, l int, r int"))
    got = {(r["genome"], r["gc"]): (r["cov"], r["n"]) for r in got.collect()}
    assert set(got) == set(want) and all(np.isclose(got[k][0], s / (n * 100)) and got[k][1] == n for k, (s, n) in want.items())


def test_spans_of_any_length(spark):
    rng = random.Random(3)
    features = [(rng.choice("ab"), a := rng.randint(1, 5000), a + rng.choice([0, 5, 90, 999, 1000, 1001, 7000, 60_000])) for _ in range(40)] + [("c", 9, 5)]
    depth = [(c, p, p % 7) for c in "abc" for p in rng.sample(range(1, 70_000), 3000)]
    f, d = spark.createDataFrame(features, "contig string, l int, r int"), spark.createDataFrame(depth, "ref_id string, pos int, depth int")
    got = D.depth_in_features(d, f)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == sorted(x for x in depth if any(c == x[0] and a <= x[1] <= b for c, a, b in features))
    assert D.depth_in_features(d, f.limit(0)).count() == 0
    few = [x for x in features if x[2] - x[1] < 2000]
    masked = D.feature_mask_positions(spark.createDataFrame(few, "contig string, l int, r int")).collect()
    assert sorted(map(tuple, masked)) == sorted({(c, p) for c, a, b in few for p in range(max(1, a - 100), b + 1)})


def test_index_grows_with_features_not_with_their_length(spark):
    from lattica.operators.depth import merged_spans

    features = spark.range(500).select(F.lit("c").alias("contig"), (F.col("id") * 10_000_000 + 1).alias("l"), (F.col("id") * 10_000_000 + 1 + F.pow(F.lit(2.0), F.col("id") % 23).cast("long")).alias("r"))
    assert merged_spans(features).count() == 500
    d = spark.createDataFrame([("c", 10_000_000 * i + 2, i) for i in range(500)], "ref_id string, pos long, depth int")
    assert D.depth_in_features(d, features).count() == 500


@pytest.mark.parametrize("seed", range(3))
def test_sparse_columns_against_a_sliding_loop(spark, seed):
    rng = random.Random(seed)
    width, window = 90, 9
    rows = ["".join(rng.choice("ACGT") if 20 < c < 60 or rng.random() < 0.006 else "-" for c in range(width)) for _ in range(60)] + ["-" * width]
    rows += ["".join("A" if 62 <= c < 75 else r for c, r in enumerate(rows[0]))]
    least, gone = 0.1, set()
    for w in range(width - window + 1):
        full = [i for i, r in enumerate(rows) if r[w : w + window] != "-" * window]
        if round(len(full) * 100 / len(rows), 3) < least * 100:
            gone |= set(full)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    assert {r["id"] for r in T.msa_sparse_column_filter(df, "id", "seq", window, least).collect()} == set(range(len(rows))) - gone and gone


def test_a_straddling_stretch_is_sparse(spark):
    rows = [(i, "A" * 13 + "-" * 25 + "A" * 13) for i in range(199)] + [(199, "A" * 51)]
    df = spark.createDataFrame(rows, "id long, seq string")
    assert 199 not in {r["id"] for r in T.msa_sparse_column_filter(df, "id", "seq").collect()}
    assert T.msa_sparse_column_filter(df.limit(0), "id", "seq").count() == 0


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_coverage_of_regions_as_spans_and_as_positions(spark):
    """Spans that cross bins and overlap, runs and positions, a null depth: as by positions; no side is broadcast, however small Spark takes it for."""
    rng = random.Random(3)
    spans = [(r, rng.choice("vc"), l := rng.randint(1, 2990), l + rng.randint(0, 1500)) for r in "ab" for _ in range(6)] + [("c", "v", 5, 9), ("a", "v", 9, 8)]
    depths = [(r, p, rng.choice([None, *range(9)])) for r in "abd" for p in range(1, 4000) if rng.random() < 0.9]
    by = {(r, p): d for r, p, d in depths}
    want = {}
    for r in "ab":
        of = {k: [d for q, kind, l, e in spans if q == r and kind == k for p in range(l, e + 1) if (d := by.get((r, p))) is not None] for k in "vc"}
        want[r] = tuple(round(sum(x) / len(x), 9) if x else None for x in (of["v"], of["c"]))
    regions, depth = spark.createDataFrame(spans, "ref_id string, kind string, l int, r int"), spark.createDataFrame(depths, "ref_id string, pos int, depth int")
    at = regions.filter("l <= r").select("ref_id", "kind", F.explode(F.sequence("l", "r")).alias("pos"))
    runs = depth.select("ref_id", F.col("pos").alias("start"), F.col("pos").alias("end"), "depth")
    for d, g in ((depth, regions), (depth, at), (runs, regions), (runs, at), (D.cut_spans(runs), regions)):
        out = D.var_con_coverage(d, g)
        assert {x["ref_id"]: tuple(None if v is None else round(v, 9) for v in (x["var"], x["con"])) for x in out.collect()} == want
        assert "BroadcastHashJoin" not in shown(out)[1]


def test_runs_across_words(spark):
    rng = random.Random(5)
    rows = [(k, p) for k in "ab" for p in range(-70, 300) if rng.random() < (0.5 if k == "a" else 0.95)] + [("c", 31), ("c", 32), ("d", 63), ("d", 0), ("e", -1), ("e", 0), ("f", None), ("a", None)] + [("g", p) for p in range(32, 96)] * 2
    want = {}
    for k in "abcdeg":
        p, runs = sorted({p for q, p in rows if q == k and p is not None}), []
        for x in p:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        want[k] = ",".join(f"{a}-{b}" for a, b in runs)
    out = D.consecutive_runs(spark.createDataFrame(rows, "k string, pos int"), "k", "pos")
    assert {r["k"]: r["runs"] for r in out.collect()} == want
    assert "bit_or" in shown(out)[0]  # positions are reduced before they are shuffled


def test_track_is_dealt_before_it_is_spread_out(spark, sf):
    from lattica.plans.fixtures import Inputs
    from lattica.plans.q_depth import track

    fx = Inputs(spark, sf)
    assert track(fx, 20).rdd.getNumPartitions() == fx.table("part").count() // 20
    assert track(fx, 20).exceptAll(fx("fx_depth")).isEmpty() and track(fx, 20).count() == fx("fx_depth").count()


def test_references_are_summed_before_they_meet_genomes(spark):
    from lattica.operators import assess as S

    genomes = [("g1", 1), ("g1", 2), ("g1", 1), ("g2", 2), ("g3", 3), ("g4", 4), ("g5", None)]
    refs = [(1, 2), (1, 4), (2, 9), (2, None), (3, None), (5, 7), (None, 1)]
    out = S.expected_copy_number(spark.createDataFrame(genomes, "genome string, cluster int"), spark.createDataFrame(refs, "cluster int, copies int"))
    assert {r["genome"]: r["copies"] for r in out.collect()} == {"g1": 5.0, "g2": 9.0, "g3": None}
    plan = shown(out)[0]
    assert plan.index("Join") < plan.rindex("sum(")  # below the join, so printed after it
