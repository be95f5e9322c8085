"""Links between markers and contigs through read pairs, their quality and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar as C


def link_reads_rd1(markers: DataFrame, contigs: DataFrame, genomes: DataFrame, hits: bool = False) -> DataFrame:
    """read_base, marker, contig: links of the first round.  markers and contigs are qualified pairs.

    A read with both mates on both sides links what its mates share; a read with single mates on both sides links them
    if the contig side lies in one genome.  Both sides are cut to one row per (read, reference) before they meet,
    so a read's rows multiply only by its distinct references.  With hits, a link also has the alignments behind it, as the arrays
    `left` and `right` (pos, cigar, ref_len), so that nobody has to join them again."""
    behind = lambda name: [F.collect_list(F.struct("pos", "cigar", "ref_len")).alias(name)] if hits else []
    m = markers.groupBy("read_base", F.col("ref_id").alias("marker")).agg(F.first("pair_class").alias("mc"), *behind("left"))
    c = contigs.groupBy("read_base", F.col("ref_id").alias("contig")).agg(F.first("pair_class").alias("cc"), *behind("right"))
    w = Window.partitionBy("read_base")
    c = c.join(genomes.select("contig", "genome"), "contig").withColumn("one", F.min("genome").over(w) == F.max("genome").over(w))
    both = m.join(c, "read_base")
    fits = ((F.col("mc") == "both") & (F.col("cc") == "both")) | ((F.col("mc") != "both") & (F.col("cc") != "both") & F.col("one"))
    return both.filter(fits).select("read_base", "marker", "contig", "genome", *(["left", "right"] if hits else []))


def link_counts(links: DataFrame) -> DataFrame:
    """Reads per (marker, contig)."""
    return links.groupBy("marker", "contig").agg(F.countDistinct("read_base").alias("n"))


def genome_link_counts(counts: DataFrame, genomes: DataFrame) -> DataFrame:
    """Reads per (marker, genome): the sum over its contigs."""
    return counts.join(genomes.select("contig", "genome"), "contig").groupBy("marker", "genome").agg(F.sum("n").alias("n"))


def side_stats(hits: DataFrame, keys: list[str], short: int = 75, near: int = 10) -> DataFrame:
    """Per key, of the alignments that link it: reads, CIGARs, short ones, those at an end, clipped ones, covered
    positions.  hits: keys, read_base, pos, cigar, ref_len.

    Covered positions are the union of intervals: cut to the furthest end from each start, so that a popular link has no
    more rows than its reference has positions, and sorted by start, each adds what lies beyond the furthest end so far."""
    cigar = F.col("cigar")
    h = hits.withColumns({"__aligned": C.aligned_length(cigar), "__clip": C.has_clip(cigar)}).withColumn("__end", F.col("pos") + F.col("__aligned") - 1)
    spans = h.groupBy(*keys, "pos").agg(F.max("__end").alias("__end"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__before", F.coalesce(F.max("__end").over(w), F.lit(0)))
    fresh = F.greatest(F.col("__end") - F.greatest(F.col("__before"), F.col("pos") - 1), F.lit(0))
    covered = spans.groupBy(*keys).agg(F.sum(fresh).alias("matched"))
    n, at_end = F.count("*"), F.sum((F.least(F.col("pos") - 1, F.col("ref_len") - F.col("__end")) <= near).cast("int"))
    # reads first, so that counting them is a plain sum
    per_read = h.groupBy(*keys, "read_base").agg(n.alias("n"), F.sum((F.col("__aligned") <= short).cast("int")).alias("short"), at_end.alias("ends"), F.sum(F.col("__clip").cast("int")).alias("clips"), F.max("ref_len").alias("len"))
    n, at_end = F.sum("n"), F.sum("ends")
    stats = per_read.groupBy(*keys).agg(
        F.count("*").alias("reads"), n.alias("cigars"), C.percent(F.sum("short"), n).alias("short_pct"), at_end.alias("end_num"),
        C.percent(at_end, n).alias("end_pct"), C.percent(F.sum("clips"), n).alias("clip_pct"), F.max("len").alias("__len"),
    )
    return stats.join(covered, keys).withColumn("matched_pct", C.percent(F.col("matched"), F.col("__len"))).drop("__len")


def link_sides(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The alignments behind links that have them: (left, right) with marker, contig, read_base, pos, cigar, ref_len."""
    side = lambda name: links.select("marker", "contig", "read_base", F.explode(name).alias("hit")).select("marker", "contig", "read_base", "hit.*")
    return side("left"), side("right")


def _both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    tag = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys))
    return tag(side_stats(left, keys), "l").join(tag(side_stats(right, keys), "r"), keys)


def _short_fine(few: int = 100, high: float = 75.0, low: float = 85.0) -> Column:
    cutoff = F.when(F.col("cigars_l") < few, low).otherwise(high)
    return (F.col("short_pct_l") < cutoff) & (F.col("short_pct_r") < cutoff)


def link_qc_rd1(left: DataFrame, right: DataFrame, keys: list[str], min_reads: int = 3, matched: int = 750) -> DataFrame:
    """Links of markers (left) and contigs (right) with their statistics and `passed`."""
    s = _both(left, right, keys).filter(F.col("reads_l") >= min_reads)
    l_end = (F.col("end_num_l") > 0) & (F.col("end_pct_l") >= 5)
    r_end = (F.col("end_num_r") >= 1) & (F.col("end_pct_r") >= 20)
    return s.withColumn("passed", _short_fine() & (l_end | (F.col("matched_l") >= matched)) & (r_end | (F.col("matched_r") >= matched)))


def clip_difference_fine(cutoff: float = 50.0, more_than: int = 15) -> Column:
    return ~((F.col("cigars_l") > more_than) & (F.abs(F.col("clip_pct_l") - F.col("clip_pct_r")) > cutoff))


def link_qc_mini_contig(left: DataFrame, right: DataFrame, keys: list[str], min_reads: int = 3, matched: int = 300, matched_pct: float = 50.0) -> DataFrame:
    """Links of mini-assemblies (left) and contigs (right): clips even on both sides, the contig's end is a must."""
    s = _both(left, right, keys).filter(F.col("reads_l") >= min_reads)
    l_end = (F.col("end_num_l") > 0) & (F.col("end_pct_l") >= 5)
    r_end = (F.col("end_num_r") >= 1) & (F.col("end_pct_r") >= 20)
    l_fine = l_end | (F.col("matched_l") >= matched) | (F.col("matched_pct_l") >= matched_pct)
    return s.withColumn("passed", _short_fine() & clip_difference_fine() & l_fine & r_end)


def link_qc_mini_marker(left: DataFrame, right: DataFrame, keys: list[str], min_reads: int = 3, matched: int = 300, matched_pct: float = 50.0) -> DataFrame:
    """Links of mini-assemblies (left) and markers (right): an end or enough matched on both sides."""
    s = _both(left, right, keys).filter(F.col("reads_l") >= min_reads)
    fine = lambda x: ((F.col(f"end_num_{x}") > 0) & (F.col(f"end_pct_{x}") >= 5)) | (F.col(f"matched_{x}") >= matched) | (F.col(f"matched_pct_{x}") >= matched_pct)
    return s.withColumn("passed", _short_fine() & fine("l") & fine("r"))


def pairwise_identity(hits: DataFrame, min_aligned: int = 500, min_cover: float = 50.0) -> DataFrame:
    """Best identity of each unordered pair.  hits: query, subject, iden, aln_len, qlen, slen."""
    cover = (F.col("aln_len") * 100 >= F.col("qlen") * min_cover) & (F.col("aln_len") * 100 >= F.col("slen") * min_cover)
    h = hits.filter((F.col("query") != F.col("subject")) & (F.col("aln_len") >= min_aligned) & cover)
    return h.groupBy(F.least("query", "subject").alias("a"), F.greatest("query", "subject").alias("b")).agg(F.max("iden").alias("iden"))


def with_identity(pairs: DataFrame, left: str, right: str, ident: DataFrame) -> DataFrame:
    """pairs with iden, looked up in either order; 0 where there is none."""
    i = ident.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("iden").alias("__i"))
    out = pairs.join(i, (F.least(left, right) == F.col("__a")) & (F.greatest(left, right) == F.col("__b")), "left")
    return out.withColumn("iden", F.coalesce("__i", F.lit(0.0))).drop("__a", "__b", "__i")


def mean_identity(ident: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """Mean identity of each member to the others of its group; a missing pair counts 0.  The sum comes from the pairs
    that have an identity, the count from the group's size, so pairs without one are never made."""
    both = ident.select(F.col("a").alias("x"), F.col("b").alias("y"), "iden").unionByName(ident.select(F.col("b").alias("x"), F.col("a").alias("y"), "iden"))
    m = members.select(group, member).distinct()
    sizes = m.withColumn("n", F.count("*").over(Window.partitionBy(group)))
    other = m.select(F.col(group).alias("__g"), F.col(member).alias("y"))
    sums = sizes.join(both, sizes[member] == both.x).join(other, "y").filter(F.col(group) == F.col("__g")).groupBy(group, member).agg(F.sum("iden").alias("s"))
    out = sizes.join(sums, [group, member], "left").filter("n > 1")
    return out.select(group, member, (F.floor(F.coalesce("s", F.lit(0.0)) / (F.col("n") - 1) * 1000 + 0.5) / 1000).alias("mean_iden"))
