from pyspark.sql import functions as F

from lattica.operators import depth as D
from lattica.operators import links as L
from lattica.operators import pairs as P
from lattica.operators import regions as G

ALN = "read_base long, mate int, ref_id string, ref_len int, pos int, cigar string"


def test_classes_of_pairs(spark):
    rows = [
        (1, 1, "a", 500, 10, "60="), (1, 2, "a", 500, 90, "60="),  # both
        (2, 1, "a", 500, 10, "60="),  # r1
        (3, 2, "b", 500, 10, "60="),  # r2
        (4, 1, "a", 500, 10, "60="), (4, 2, "b", 500, 10, "60="),  # nothing shared: out
        (5, 1, "a", 500, 10, "60="), (5, 1, "a", 500, 200, "60="), (5, 1, "b", 500, 10, "60="),  # a is hit twice: out
        (6, 1, "a", 500, 10, "60="), (6, 2, "a", 500, 10, "20S60="),  # bad for one mate: out for both
        (7, 1, "a", 500, 10, "60="), (7, 1, "b", 500, 10, "59=1X"),  # worse than the best
        (8, 1, "a", 500, 10, "*"), (9, 1, "a", 500, 10, "30="),
    ]
    got = {(r["read_base"], r["ref_id"], r["mate"]): r["pair_class"] for r in P.qualify_pairs(spark.createDataFrame(rows, ALN)).collect()}
    assert got == {(1, "a", 1): "both", (1, "a", 2): "both", (2, "a", 1): "r1", (3, "b", 2): "r2", (5, "b", 1): "r1", (7, "a", 1): "r1"}


def test_single_mates_link_only_into_one_genome(spark):
    pairs = "read_base long, pair_class string, ref_id string, mate int, pos int, cigar string, ref_len int"
    row = lambda read, kind, ref: (read, kind, ref, 1, 5, "60=", 500)
    m = spark.createDataFrame([row(1, "r1", "m"), row(2, "both", "m"), row(3, "r2", "m"), row(4, "both", "m")], pairs)
    c = spark.createDataFrame([row(1, "r2", "c1"), row(1, "r2", "c2"), row(2, "both", "c1"), row(2, "both", "c3"), row(3, "r1", "c1"), row(3, "r1", "c3"), row(4, "r1", "c1")], pairs)
    g = spark.createDataFrame([("c1", "g"), ("c2", "g"), ("c3", "h")], "contig string, genome string")
    got = sorted((r["read_base"], r["contig"]) for r in L.link_reads_rd1(m, c, g).collect())
    assert got == [(1, "c1"), (1, "c2"), (2, "c1"), (2, "c3")]


def test_covered_positions_are_a_union(spark):
    hits = spark.createDataFrame([("k", 1, 10, "50=", 300), ("k", 2, 30, "50=", 300), ("k", 3, 200, "20=", 300), ("k", 4, 205, "5=", 300)], "key string, read_base long, pos int, cigar string, ref_len int")
    r = L.side_stats(hits, ["key"]).first()
    assert (r["matched"], r["reads"], r["end_num"]) == (len({*range(10, 60), *range(30, 80), *range(200, 220)}), 4, 1)


def test_depth_and_trimmed_mean_with_equal_cuts(spark):
    aln = spark.createDataFrame([(1, 1, "a", 400, 1, "400="), (2, 1, "a", 400, 395, "10="), (3, 1, "a", 400, 200, "10=5I10=")], ALN)
    refs = spark.createDataFrame([("a", 400), ("b", 5)], "ref_id string, ref_len int")
    depth = {(r["ref_id"], r["pos"]): r["depth"] for r in D.depth_by_base(aln, refs).collect()}
    assert len(depth) == 405 and depth["a", 1] == 1 and depth["a", 400] == 2 and depth["a", 219] == 2 and depth["a", 220] == 1 and depth["b", 3] == 0
    # 100 inner positions of one depth: the cuts are equal, and a position uses up both quotas
    flat = spark.range(1, 401).select(F.lit("a").alias("ref_id"), F.col("id").cast("int").alias("pos"), F.lit(7).alias("depth"))
    r = D.trimmed_mean_depth(flat, refs).first()
    assert (r["low_cut"], r["high_cut"], r["counted"], r["mean_depth"]) == (7, 7, 75, 7.0)


def test_regions(spark):
    rows = [("s", 1500, v, *((None, None) if v == 3 else (v * 150 - 100, v * 150 - 40))) for v in range(1, 10)]
    spans = G.all_regions(spark.createDataFrame(rows, "seq_id string, ref_len int, v long, l int, r int"))
    got = {(r["ord"]): (r["l"], r["r"]) for r in spans.collect()}
    assert got[1] == (1, 49) and got[3] == (111, 199) and got[5] == (None, None) and got[7] == (None, None) and got[19] == (1311, 1500)
    trimmed = {r["ord"]: (r["l"], r["r"]) for r in G.trim_regions(spans).collect()}
    assert trimmed[1] == (None, None) and trimmed[4] == (215, 245)
    assert {r["ord"] for r in G.flank_filter(G.trim_regions(spans)).filter("l is not null").collect()} <= {o for o, (a, _) in trimmed.items() if a}


def test_gc_bias_lists_missing_buckets_as_null(spark):
    m = spark.createDataFrame([("m", "g", 10.0, 50.4, 40.0), ("n", "g", 10.0, 77.0, 40.0)], "marker string, genome string, depth double, gc_marker double, gc_genome double")
    prof = spark.createDataFrame([("g", 50, 4.0), ("g", 40, 2.0)], "genome string, gc int, cov double")
    assert {r["marker"]: r["depth_norm"] for r in D.gc_normalised_depth(m, prof).collect()} == {"m": 5.0, "n": None}


def test_samples_keep_mates_and_nest(spark):
    reads = spark.range(4000).select((F.col("id") / 2).cast("long").alias("read_base"), (F.col("id") % 2 + 1).alias("mate"))
    ten, forty = ({(r["read_base"], r["mate"]) for r in P.sample_pairs(reads, p).collect()} for p in (10, 40))
    assert ten < forty and all((b, 3 - m) in ten for b, m in ten) and 100 < len(ten) / 2 < 300
    by_rate = P.sample_rates(reads, [10, 40]).groupBy("rate").count().collect()
    assert {r["rate"]: r["count"] for r in by_rate} == {10.0: len(ten), 40.0: len(forty)}


def test_filter_names_a_made_cigar_once(spark):
    """A CIGAR that is made by a long expression stands once in the filter on mapped rows, which Spark moves below it."""
    made = spark.range(5).select(F.concat(F.col("id").cast("string"), F.lit("=")).alias("cigar"))
    filters = [x for x in P.mapped(made)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert sum(x.count("concat(") for x in filters) == 1
    rows = spark.createDataFrame([("*",), (None,), ("",), ("5=",)], "cigar string")
    assert sorted(r["cigar"] for r in P.mapped(rows).collect()) == ["", "5="]


def test_clips_are_read_once_and_no_cast_fails(spark):
    rows = [(1, "12S30="), (1, "7s30=9S"), (2, "30="), (3, "30=4S"), (3, "2S30=8S"), (4, "*"), (4, None)]
    out = P.min_max_clip(spark.createDataFrame(rows, "read_base long, cigar string"))
    assert {tuple(r) for r in out.collect()} == {(1, 7, 12), (2, 0, 0), (3, 2, 8)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2
    assert "concat(0, regexp_extract" in plan  # a number before the cast, also where there is no clip


def test_links_carry_their_alignments(spark, monkeypatch):
    """F12 to F18: what lies behind links comes with them.  Bridges and contigs stay where they are dealt by read; only the genomes' join, by contig, deals contigs again."""
    from lattica.operators import rounds as W

    schema = "read_base long, mate int, ref_id string, ref_len int, pos int, cigar string"
    marker = [(1, 1, "M1", 900, 5, "60="), (1, 2, "M1", 900, 90, "60="), (2, 1, "M1", 900, 7, "70="), (3, 1, "M1", 900, 1, "60="), (3, 1, "M1", 900, 9, "60="), (4, 1, "M1", 900, None, "60=")]
    contig = [(1, 1, "C1", 500, 1, "50="), (1, 2, "C1", 500, 60, "50="), (2, 1, "C1", 500, 1, "20S50="), (2, 1, "C1", 500, 1, "20S50="), (3, 1, "C1", 500, 1, "50="), (4, 1, "C1", 500, 1, "50=")]
    m, c = (P.qualify_pairs(spark.createDataFrame(rows, schema)) for rows in (marker, contig))
    found = L.link_reads_rd1(m, c, spark.createDataFrame([("C1", "G1")], "contig string, genome string"), hits=True)
    left, right = ([tuple(r) for r in side.collect()] for side in L.link_sides(found))
    assert sorted(left) == [("M1", "C1", 1, 5, "60=", 900), ("M1", "C1", 1, 90, "60=", 900), ("M1", "C1", 2, 7, "70=", 900)]
    assert sorted(right) == [("M1", "C1", 1, 1, "50=", 500), ("M1", "C1", 1, 60, "50=", 500), ("M1", "C1", 2, 1, "20S50=", 500)]
    seen = []
    monkeypatch.setattr(W, "cut", lambda df, name: seen.append(df) or df)
    W.link_reads_mini(m, c, "contig")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, shuffles in ((found, 3), (seen[0], 2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(read_base") == shuffles and "mate" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
