"""Ends of contigs, features at ends, joined sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def contig_ends(seqs: DataFrame, length: int | Column = 1000, id_col: str = "seq_id", seq_col: str = "seq") -> DataFrame:
    """id_col, side, seq: the first and last `length` bases (l, r) of each sequence; one shorter than two ends is one row, whole."""
    k = (F.lit(length) if isinstance(length, int) else length).cast("int")
    whole = F.array(F.struct(F.lit("").alias("side"), F.col(seq_col).alias("seq")))
    ends = F.array(F.struct(F.lit("l").alias("side"), F.left(seq_col, k).alias("seq")), F.struct(F.lit("r").alias("side"), F.right(seq_col, k).alias("seq")))
    return seqs.select(id_col, F.explode(F.when(F.length(seq_col) < 2 * k, whole).otherwise(ends)).alias("e")).select(id_col, "e.side", "e.seq")


def trim_terminal_feature(contigs: DataFrame, features: DataFrame, within: int = 100) -> DataFrame:
    """contig, kept_from, kept_to: the part of each contig that has a feature at an end, without that feature.

    contigs: contig, ref_len; features: contig, l, r.  A feature is at the left end if at most `within` bases lie before it, else at
    the right end if at most `within` lie behind it (its last base aside); of several the one with the smallest gap is
    taken, ties by start and end.  Behind a left feature all is kept; before a right one all up to its first base."""
    f = features.join(contigs.select("contig", "ref_len"), "contig")
    left, right = F.col("l") - 1, F.col("ref_len") - F.col("r") - 1
    gap = F.when(left <= within, left).when(right <= within, right)
    best = f.withColumns({"gap": gap, "at_left": left <= within}).filter("gap is not null")
    best = best.groupBy("contig").agg(F.min(F.struct("gap", "l", "r", "at_left", "ref_len")).alias("b"))
    return best.select("contig", F.when(F.col("b.at_left"), F.col("b.r") + 1).otherwise(1).alias("kept_from"), F.when(F.col("b.at_left"), F.col("b.ref_len")).otherwise(F.col("b.l")).alias("kept_to"))


def linked_end(hits: DataFrame, ref: str = "ref_id", near: int | None = None) -> DataFrame:
    """ref, mid, linked_end: on which third of a reference its alignments lie, by their median position; with `near`, whether that is
    within so many bases of an end.  hits: ref, pos, ref_len."""
    mid, n = F.percentile("pos", 0.5), F.max("ref_len")
    low, high = (mid <= n / 3, mid >= n * 2 / 3) if near is None else (mid <= near, n - mid <= near)
    return hits.groupBy(ref).agg(mid.alias("mid"), F.when(low, "left").when(high, "right").otherwise("middle").alias("linked_end"))


def join_sequences(pairs: DataFrame, left_end: str, right_end: str, gap: int = 50) -> DataFrame:
    """pairs (left, right: sequences, and the columns named, which say at which end each is linked) with `joined` and `junction`.

    The left one is turned so that its linked end is its right one, the right one so that its is the left one; between them lie `gap`
    unknown bases."""
    a = F.when(F.col(left_end) == "left", S.reverse_complement(F.col("left"))).otherwise(F.col("left"))
    b = F.when(F.col(right_end) == "right", S.reverse_complement(F.col("right"))).otherwise(F.col("right"))
    return pairs.withColumn("joined", F.concat(a, F.repeat(F.lit("N"), F.lit(gap)), b)).withColumn("junction", F.length("left").cast("long"))
