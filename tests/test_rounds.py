"""Both rounds of linking, copy numbers and sequence ends on hand-made cases."""

from pyspark.sql import functions as F

from lattica.operators import depth as D
from lattica.operators import rounds as W
from lattica.operators import sequences as Q

ALN = "read_base long, mate int, ref_id string, ref_len int, pos int, cigar string"


def pairs_of(start, n, marker, contig, m_len=1500, c_len=900):
    """n read pairs whose first mate ends the marker and whose second one begins the contig, 100 bases each."""
    a = [(start + i, 1, marker, m_len, m_len - 99 - i % 8, "100=") for i in range(n)]
    return a, [(start + i, 2, contig, c_len, 1 + i % 8, "100=") for i in range(n)]


def test_link_markers_takes_both_rounds(spark):
    """m1 and m1b (a near copy with fewer reads) go to g1 by pairs; m2 has too few pairs for g2 and gets there by a bridge;
    m3 has pairs with two genomes and goes to the one with more."""
    m, c, x = [], [], []
    for start, n, marker, contig in ((0, 30, "m1", "c1"), (100, 26, "m1b", "c1"), (200, 4, "m2", "c2"), (300, 20, "m3", "c3"), (400, 11, "m3", "c4"), (500, 14, "m4", "c1")):
        a, b = pairs_of(start, n, marker, contig)
        m, c = m + a, c + b
    for i in range(12):  # a bridge: mate 1 on the contig and on the bridge; mate 1 on the marker, its partner on the bridge
        c.append((1000 + i, 1, "c2", 900, 1 + i % 5, "100="))
        x.append((1000 + i, 1, "x1", 500, 401 - i % 5, "100="))
        m.append((2000 + i, 1, "m2", 1500, 1401 - i % 5, "100="))
        x.append((2000 + i, 2, "x1", 500, 1 + i % 5, "100="))
    frame = lambda rows: spark.createDataFrame(rows, ALN)
    genomes = spark.createDataFrame([(f"c{i}", f"g{i}") for i in range(1, 5)], "contig string, genome string")
    lengths = spark.createDataFrame([(k, 1500) for k in ("m1", "m1b", "m2", "m3", "m4")], "marker string, ref_len int")
    ident = spark.createDataFrame([("m1", "m1b", 99.5), ("m1", "m4", 90.0)], "a string, b string, iden double")
    both = W.link_markers(frame(m), frame(c), frame(x), genomes, lengths, ident)
    # m1b has 26 of 30, above 80 percent; m4 is unlike m1
    assert sorted(tuple(r) for r in both.collect()) == [("m1", "g1", 30, "Rd1"), ("m1b", "g1", 26, "Rd1"), ("m2", "g2", 12, "Rd2"), ("m3", "g3", 20, "Rd1")]
    one = W.link_markers(frame(m), frame(c), None, genomes, lengths, ident)
    assert sorted(r["marker"] for r in one.collect()) == ["m1", "m1b", "m3"]
    none = W.link_markers(frame([]), frame([]), frame([]), genomes, lengths, ident)
    assert none.count() == 0
    # of a read of 100 aligned and 90 clipped bases 53 percent are aligned
    clipped = [(r[0], r[1], r[2], r[3], r[3] - 99, "100=90S") if r[0] < 100 else r for r in m]
    kept = W.link_markers(frame(clipped), frame(c), None, genomes, lengths, ident, aligned_pct=60)
    assert sorted(r["marker"] for r in kept.collect()) == ["m1b", "m3"]


def test_features_at_ends_the_smallest_gap_wins(spark):
    contigs = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000), ("d", 1000), ("e", 120)], "contig string, ref_len int")
    rows = [("a", 50, 200), ("a", 700, 990), ("b", 300, 400), ("b", 700, 899), ("c", 300, 400), ("d", 101, 300), ("d", 20, 90), ("e", 10, 115)]
    got = {r["contig"]: (r["kept_from"], r["kept_to"]) for r in Q.trim_terminal_feature(contigs, spark.createDataFrame(rows, "contig string, l int, r int")).collect()}
    # a: gaps 49 and 9; b: the second one is 100 from the right end; c has none; e is near both ends and counts as left
    assert got == {"a": (1, 700), "b": (1, 700), "d": (91, 1000), "e": (116, 120)}


def test_joined_sequences_meet_at_their_linked_ends(spark):
    df = spark.createDataFrame([("AAC", "GGT", "right", "left"), ("AAC", "GGT", "left", "right"), ("AAC", "GGT", "left", "left")], "left string, right string, x string, y string")
    assert [(r["joined"], r["junction"]) for r in Q.join_sequences(df, "x", "y", 2).collect()] == [("AACNNGGT", 3), ("GTTNNACC", 3), ("GTTNNGGT", 3)]


def test_masked_windows_are_left_out(spark):
    seq = "ACGT" * 60
    depth = spark.createDataFrame([("s", i + 1, 10) for i in range(240)], "ref_id string, pos int, depth int")
    seqs = spark.createDataFrame([("g", "s", seq)], "genome string, ref_id string, seq string")
    count = lambda **more: D.gc_bias_profile(depth, seqs, window=20, ends=0, min_len=50, **more).agg(F.sum("n")).first()[0]
    mask = D.feature_mask_positions(spark.createDataFrame([("s", 101, 110)], "contig string, l int, r int"), before=10)
    # windows that start in 91..110 or end there (start in 72..91)
    assert count() == 221 and count(tile=50) == 221 and count(mask=mask) == 221 - 39 == count(mask=mask, tile=50)


def test_copy_numbers_choose_between_all_and_linked(spark):
    """A marker of even depth: 3 copies; with doubled variable regions only linked reads tell the depth."""
    refs = spark.createDataFrame([("m1", 400), ("m2", 400)], "ref_id string, ref_len int")
    whole = lambda ref, n, start=0: [(start + i, 1, ref, 400, 1, "400=") for i in range(n)]
    extra = [(900 + i, 1, "m2", 400, 201, "100=") for i in range(30)]
    aln, linked = whole("m1", 30) + whole("m2", 30, 100) + extra, whole("m1", 30) + whole("m2", 20, 100)
    regions = spark.createDataFrame([(m, k, p) for m in ("m1", "m2") for k, a in (("v", 201), ("c", 50)) for p in range(a, a + 100)], "ref_id string, kind string, pos int")
    profile = spark.createDataFrame([("g", 45, 10.0, 100, 1.0, 45.0)], "genome string, gc int, cov double, n long, prop double, gc_genome double")
    markers = spark.createDataFrame([("m1", 45.0), ("m2", 45.0)], "marker string, gc_marker double")
    links = spark.createDataFrame([("m1", "g"), ("m2", "g")], "marker string, genome string")
    frame = lambda rows: spark.createDataFrame(rows, ALN)
    got = {r["marker"]: (r["best_depth"], r["copies"]) for r in D.copy_numbers(frame(aln), frame(linked), refs, regions, markers, profile, links, ends=0).collect()}
    assert got == {"m1": (30.0, 3.0), "m2": (20.0, 2.0)}


def test_intermediates_can_be_released(spark):
    import os

    from lattica.operators import groups as G

    path = G.cut(spark.range(3), "some").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and G.release(spark) > 0 and not os.path.exists(path) and G.release(spark) == 0
