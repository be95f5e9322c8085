"""Alignments per read pair: best mismatch, single hits, qualified pairs.

Alignments have read_base, mate (1 or 2), ref_id, ref_len, pos and cigar (null or `*`: unmapped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar as C


def mapped(aln: DataFrame) -> DataFrame:
    return aln.filter(C.is_mapped(F.col("cigar")))


def ref_min_mismatch(aln: DataFrame, min_aligned: int = 45) -> DataFrame:
    """Least mismatch percentage of each (read_base, mate), over long alignments if it has any."""
    bad = C.mismatch_percent(F.col("cigar"))
    long_bad = F.when(C.aligned_length(F.col("cigar")) >= min_aligned, bad)
    return mapped(aln).groupBy("read_base", "mate").agg(F.coalesce(F.min(long_bad), F.min(bad)).alias("min_mismatch"))


def multi_hit_refs(aln: DataFrame) -> DataFrame:
    """(read_base, ref_id) that a mate hits at several positions."""
    many = mapped(aln).groupBy("read_base", "mate", "ref_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return many.filter("a <> b").select("read_base", "ref_id").distinct()


def _read(aln: DataFrame, mismatch_cutoff: float, min_aligned: int, use_ref_min: bool, aligned_pct: float | None) -> DataFrame:
    """Mapped alignments, dealt by read, with `fine`: whether each is good by itself (and, with use_ref_min, beside its mate's best).  CIGARs are read once, into lengths."""
    cigar, pos, length = F.col("cigar"), F.col("pos"), F.col("ref_len")
    a = mapped(aln).withColumns({"aligned": C.aligned_length(cigar), "wrong": C.op_length(cigar, "IXDixd"), "left_clip": C.left_clipped(cigar), "right_clip": C.right_clipped(cigar), "clip": C.has_clip(cigar), "both_clip": C.both_ends_clipped(cigar)})
    if aligned_pct is not None:
        a = a.filter(F.col("aligned") * 100 >= (F.col("aligned") + C.clipped_length(cigar)) * aligned_pct)
    a = a.withColumn("bad", C.percent(F.col("wrong"), F.col("aligned")))
    middle = F.col("clip") & ~(F.col("left_clip") & (pos == 1)) & ~(F.col("right_clip") & (pos + F.col("aligned") - 1 == length))
    fine = F.coalesce(~F.col("both_clip") & (F.col("bad") <= mismatch_cutoff) & (F.col("aligned") >= min_aligned) & ~middle, F.lit(False))
    a = a.select("read_base", "mate", "ref_id", "ref_len", "pos", "cigar", fine.alias("fine"), *(["bad", (F.col("aligned") >= min_aligned).alias("long")] if use_ref_min else [])).repartition("read_base")
    if not use_ref_min:
        return a
    read = Window.partitionBy("read_base")  # the best of each mate, over long alignments if it has any
    least = lambda m: F.coalesce(*(F.min(F.when((F.col("mate") == m) & c, F.col("bad"))).over(read) for c in (F.col("long"), F.lit(True))))
    a = a.sortWithinPartitions("read_base", "ref_id").withColumns({"least_1": least(1), "least_2": least(2)})
    within = F.col("bad") <= F.when(F.col("mate") == 1, F.col("least_1")).otherwise(F.col("least_2"))
    return a.withColumn("fine", F.coalesce(F.col("fine") & within, F.lit(False)))


def qualify_pairs(aln: DataFrame, mismatch_cutoff: float = 2.0, min_aligned: int = 45, use_ref_min: bool = True, aligned_pct: float | None = None) -> DataFrame:
    """read_base, pair_class (r1, r2, both), ref_id, mate, pos, cigar, ref_len of qualified alignments.

    A reference that either mate hits badly or at several positions is out for both.  A read with references for both
    mates keeps those that they share, and is out if there are none.  aligned_pct, if given, first drops alignments of which a
    smaller percentage of the read is aligned.

    One shuffle and one sort, by (read, reference): all that concerns a reference of a read is one window, all that concerns a read another."""
    a = _read(aln, mismatch_cutoff, min_aligned, use_ref_min, aligned_pct)
    ref, read = Window.partitionBy("read_base", "ref_id"), Window.partitionBy("read_base")
    of = lambda m: F.when(F.col("mate") == m, F.col("pos"))
    has = {m: F.coalesce(F.max(F.col("mate") == m).over(ref), F.lit(False)) for m in (1, 2)}
    several = lambda m: F.coalesce(F.min(of(m)).over(ref) != F.max(of(m)).over(ref), has[m])
    a = a.withColumns({"kept": F.min("fine").over(ref) & ~several(1) & ~several(2), "mates": has[1] & has[2]}).filter("kept")
    a = a.withColumns({"r1": F.max(F.col("mate") == 1).over(read), "r2": F.max(F.col("mate") == 2).over(read)}).filter("not (r1 and r2) or mates")
    kind = F.when(F.col("r1") & F.col("r2"), "both").when(F.col("r1"), "r1").otherwise("r2")
    return a.select("read_base", kind.alias("pair_class"), "ref_id", "mate", "pos", "cigar", "ref_len").distinct()


def both_mates_mapped(aln: DataFrame) -> DataFrame:
    """Alignments of reads whose two mates are mapped."""
    w = Window.partitionBy("read_base")
    m = mapped(aln).withColumn("__a", F.min("mate").over(w)).withColumn("__b", F.max("mate").over(w))
    return m.filter("__a <> __b").drop("__a", "__b")


def unmapped_mates(aln: DataFrame) -> DataFrame:
    """(read_base, mate): the mate that is missing where only one is mapped."""
    one = mapped(aln).groupBy("read_base").agg(F.min("mate").alias("a"), F.max("mate").alias("b")).filter("a = b")
    return one.select("read_base", (3 - F.col("a")).alias("mate"))


def unique_alignments(aln: DataFrame) -> DataFrame:
    """Alignments of mates that hit one reference."""
    w = Window.partitionBy("read_base", "mate")
    m = mapped(aln).withColumn("__a", F.min("ref_id").over(w)).withColumn("__b", F.max("ref_id").over(w))
    return m.filter("__a = __b").drop("__a", "__b")


def remove_both_ends_clipped(aln: DataFrame) -> DataFrame:
    """Alignments without those clipped at both ends; unmapped rows stay."""
    return aln.filter(~F.coalesce(C.both_ends_clipped(F.col("cigar")), F.lit(False)))


def remove_high_mismatch(aln: DataFrame, mismatch_cutoff: float = 2.0, min_aligned: int = 45) -> DataFrame:
    """Qualified alignments (insertions do not count as aligned); unmapped rows stay."""
    unmapped = F.col("cigar").isNull() | (F.col("cigar") == "*")
    return aln.filter(unmapped | C.cigar_qualified(F.col("cigar"), F.col("pos"), F.col("ref_len"), mismatch_cutoff, min_aligned, include_ins=False))


def keep_best_matches(aln: DataFrame, factor: float = 1.5, min_aligned: int | None = None) -> DataFrame:
    """Alignments whose mismatch is at most factor x the least of their mate (of its long alignments, if it has any
    of min_aligned or more)."""
    w = Window.partitionBy("read_base", "mate")
    bad, aligned = C.mismatch_percent(F.col("cigar")), C.aligned_length(F.col("cigar"))
    least = F.min("__bad").over(w)
    if min_aligned is not None:
        least = F.coalesce(F.min(F.when(F.col("__len") >= min_aligned, F.col("__bad"))).over(w), least)
    m = mapped(aln).withColumns({"__bad": bad, "__len": aligned})
    return m.withColumn("__least", least).filter(F.col("__bad") <= F.col("__least") * factor).drop("__bad", "__len", "__least")


def insert_size_filter(aln: DataFrame, least: int = -1000) -> DataFrame:
    """(read_base, ref_id, gap) of pairs with both mates on a reference, whose gap between the left one's end and the
    right one's start is `least` or more.  One aggregate, no self-join; of several hits of a mate the first counts."""
    end = F.col("pos") + C.aligned_length(F.col("cigar"), include_ins=False)
    m = mapped(aln).groupBy("read_base", "ref_id", "mate").agg(F.min(F.struct("pos", end.alias("end"))).alias("h"))
    both = m.groupBy("read_base", "ref_id").agg(F.count("*").alias("n"), F.min("h").alias("left"), F.max("h").alias("right")).filter("n = 2")
    return both.select("read_base", "ref_id", (F.col("right.pos") - F.col("left.end")).alias("gap")).filter(F.col("gap") >= least)


def fetch_reads_by_id(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Both mates of the reads whose base is in ids."""
    return reads.join(ids.select("read_base").distinct(), "read_base", "left_semi")


def split_paired_singleton(reads: DataFrame) -> DataFrame:
    """reads with `paired`: whether both mates are there."""
    w = Window.partitionBy("read_base")
    return reads.withColumn("paired", F.min("mate").over(w) != F.max("mate").over(w))


def drop_unlinked_refs(aln: DataFrame, refs: DataFrame) -> DataFrame:
    return aln.join(refs.select("ref_id"), "ref_id", "left_anti")


def drop_reads_touching(aln: DataFrame, refs: DataFrame) -> DataFrame:
    """Alignments of reads none of whose references is in refs."""
    touching = aln.join(refs.select("ref_id"), "ref_id", "left_semi").select("read_base").distinct()
    return aln.join(touching, "read_base", "left_anti")


def contig_end_mask(aln: DataFrame, mask: DataFrame, distance: int = 50) -> DataFrame:
    """Alignments that do not lie within `distance` of a masked end (contig, side left or right)."""
    end = F.col("pos") + C.aligned_length(F.col("cigar")) - 1
    m = mask.groupBy(F.col("contig").alias("__c")).agg(F.max((F.col("side") == "left").cast("int")).alias("__l"), F.max((F.col("side") == "right").cast("int")).alias("__r"))
    near_left, near_right = F.col("pos") <= distance, F.col("ref_len") - end <= distance
    out = aln.join(m, F.col("ref_id") == F.col("__c"), "left")
    hit = ((F.col("__l") == 1) & near_left) | ((F.col("__r") == 1) & near_right)
    return out.filter(~F.coalesce(hit, F.lit(False))).drop("__c", "__l", "__r")


def pick_one_ref(aln: DataFrame, seed: int = 42) -> DataFrame:
    """One reference per mate of a read, by a seeded hash."""
    w = Window.partitionBy("read_base", "mate").orderBy(F.md5(F.concat_ws("|", "read_base", "mate", "ref_id", "pos", F.lit(seed))), "cigar")
    return mapped(aln).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def sample_pairs(reads: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """A share of the read bases, the same ones in whatever file they stand; higher shares hold lower ones."""
    return reads.filter(sample_bucket(seed) < int(percent * 100))


def sample_bucket(seed: int = 42):
    """A number from 0 to 9999 for each read base."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("read_base"), F.lit(seed))), 1, 8), 16, 10).cast("long") % 10000).cast("int")


def sample_rates(reads: DataFrame, percents: list[float], seed: int = 42) -> DataFrame:
    """reads once for each rate whose sample holds them, tagged by it."""
    rates = F.filter(F.array(*(F.lit(float(p)) for p in percents)), lambda p: F.col("__b") < p * 100)
    return reads.withColumn("__b", sample_bucket(seed)).withColumn("rate", F.explode(rates)).drop("__b")


def max_clip(aln: DataFrame) -> DataFrame:
    """read_base, clip_len, clip_end (r1_l to r2_r), cigar: the longest clip of a read's alignments; ties go to the first by
    mate, CIGAR, left before right.  Both are empty where nothing is clipped.  A minimum of structs, so it aggregates partially."""
    ends = F.array(F.struct(F.lit("l").alias("side"), C.left_clip_length(F.col("cigar")).alias("n")), F.struct(F.lit("r").alias("side"), C.right_clip_length(F.col("cigar")).alias("n")))
    e = mapped(aln).select("read_base", "mate", "cigar", F.explode(ends).alias("e"))
    best = e.groupBy("read_base").agg(F.min(F.struct((-F.col("e.n")).alias("n"), "mate", "cigar", F.col("e.side").alias("side"))).alias("b"))
    some = F.col("b.n") < 0
    return best.select("read_base", (-F.col("b.n")).alias("clip_len"), F.when(some, F.concat(F.lit("r"), F.col("b.mate").cast("string"), F.lit("_"), "b.side")).otherwise("").alias("clip_end"), F.when(some, F.col("b.cigar")).otherwise("").alias("cigar"))


def min_max_clip(aln: DataFrame) -> DataFrame:
    """read_base, min_clip, max_clip over the clipped ends of a read's alignments; an alignment without a clip counts as 0."""
    ends = mapped(aln).select("read_base", C.left_clip_length(F.col("cigar")).alias("left"), C.right_clip_length(F.col("cigar")).alias("right"))  # each read once
    left, right = F.col("left"), F.col("right")
    shortest = F.when(left == 0, right).when(right == 0, left).otherwise(F.least(left, right))
    return ends.groupBy("read_base").agg(F.min(shortest).alias("min_clip"), F.max(F.greatest(left, right)).alias("max_clip"))
