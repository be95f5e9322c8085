"""CIGAR strings as column expressions.

Aligned operations are M, I, X and = (`include_ins=False` leaves I out), clipped ones S, mismatches I, D and X,
in either case.  Percentages are rounded half up to integer hundredths and returned as doubles, so that no
engine's rounding of ties matters.  A null or `*` CIGAR has lengths of zero and null percentages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, half up; null if whole is zero."""
    return F.when(whole != 0, F.floor((part * 20000 + whole) / (whole * 2)) / 100)


def is_mapped(cigar: Column) -> Column:
    """Neither null nor `*`.  The CIGAR stands in it once: Spark moves a filter below the expression that a CIGAR is made by and writes that out wherever
    the filter names it; with two or three copies of a long one the generated method is too long for the JVM to compile."""
    return F.coalesce(cigar, F.lit("*")) != "*"


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>>."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z=])"), F.lit(1)), lambda x: x.cast("int"))
    return F.arrays_zip(n.alias("len"), F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z=])"), F.lit(2)).alias("op"))


def op_length(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of some operations, given as a character class."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0))


def aligned_length(cigar: Column, include_ins: bool = True) -> Column:
    return op_length(cigar, "MIXmix=" if include_ins else "MXmx=")


def clipped_length(cigar: Column) -> Column:
    return op_length(cigar, "Ss")


def mismatch_percent(cigar: Column, include_ins: bool = True) -> Column:
    return percent(op_length(cigar, "IXDixd"), aligned_length(cigar, include_ins))


def cigar_stats(cigar: Column, include_ins: bool = True) -> Column:
    """struct<aln_len, aln_pct, clip_len, clip_pct, mismatch_pct>."""
    aligned, clipped = aligned_length(cigar, include_ins), clipped_length(cigar)
    return F.struct(
        aligned.alias("aln_len"), percent(aligned, aligned + clipped).alias("aln_pct"), clipped.alias("clip_len"),
        percent(clipped, aligned + clipped).alias("clip_pct"), mismatch_percent(cigar, include_ins).alias("mismatch_pct"),
    )


def left_clipped(cigar: Column) -> Column:
    return cigar.rlike(r"^\d+[Ss]")


def right_clipped(cigar: Column) -> Column:
    return cigar.rlike(r"[Ss]$")


def has_clip(cigar: Column) -> Column:
    return cigar.rlike("[Ss]")


def both_ends_clipped(cigar: Column) -> Column:
    """Three operations or more, with a clip at both ends."""
    return cigar.rlike(r"^\d+[Ss](\d+[A-Za-z=])+\d+[Ss]$")


def clip_in_middle(cigar: Column, pos: Column, ref_len: Column, include_ins: bool = True) -> Column:
    """A clip that neither the reference's start nor its end explains."""
    at_start = left_clipped(cigar) & (pos == 1)
    at_end = right_clipped(cigar) & (pos + aligned_length(cigar, include_ins) - 1 == ref_len)
    return has_clip(cigar) & ~at_start & ~at_end


def cigar_qualified(cigar: Column, pos: Column, ref_len: Column, mismatch_cutoff: float = 2.0, min_aligned: int = 45, ref_min: Column | None = None, include_ins: bool = True) -> Column:
    """Whether an alignment passes; with ref_min, its mismatches may not exceed that either (null fails)."""
    bad = mismatch_percent(cigar, include_ins)
    fine = ~both_ends_clipped(cigar) & (bad <= mismatch_cutoff) & (aligned_length(cigar, include_ins) >= min_aligned) & ~clip_in_middle(cigar, pos, ref_len, include_ins)
    if ref_min is not None:
        fine = fine & (bad <= ref_min)
    return F.coalesce(fine, F.lit(False))


def min_dist_to_end(cigar: Column, pos: Column, ref_len: Column) -> Column:
    return F.least(pos - 1, ref_len - pos - aligned_length(cigar) + 1)


def _number(digits: Column) -> Column:
    """Empty: 0.  A zero in front lets every cast succeed; a failing one costs an exception a row."""
    return F.coalesce(F.concat(F.lit("0"), digits).try_cast("int"), F.lit(0))


def left_clip_length(cigar: Column) -> Column:
    return _number(F.regexp_extract(cigar, r"^(\d+)[Ss]", 1))


def right_clip_length(cigar: Column) -> Column:
    return _number(F.regexp_extract(cigar, r"(\d+)[Ss]$", 1))
