"""The two rounds of linking: bridges, unions of rounds, and one call from alignments to genomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import assign, links, pairs
from .groups import cut


def link_reads_mini(minis: DataFrame, others: DataFrame, name: str, opposite_mate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(left, right): the alignments behind links of bridges and of markers or contigs, with mini, name, read_base, pos, cigar, ref_len.

    Both inputs are qualified pairs.  A contig and a bridge are linked by a mate that hits both, a marker and a bridge
    (opposite_mate) by a mate that hits the one and its partner that hits the other.  What they have in common is written once, for both sides.  Mates are
    compared behind the join, which is by read alone, so pairs that qualify_pairs has dealt by read stay where they are."""
    mate = (3 - F.col("mate")) if opposite_mate else F.col("mate")
    m = minis.select("read_base", F.col("mate").alias("m_mate"), F.col("ref_id").alias("mini"), *(F.col(c).alias(f"m_{c}") for c in ("pos", "cigar", "ref_len")))
    o = others.select("read_base", mate.alias("o_mate"), F.col("ref_id").alias(name), *(F.col(c).alias(f"o_{c}") for c in ("pos", "cigar", "ref_len")))
    both = cut(m.join(o, "read_base").filter(F.col("m_mate") - F.col("o_mate") == 0).drop("m_mate", "o_mate"), "sides")  # no equality of columns: that would be a key
    side = lambda s: both.select("mini", name, "read_base", *(F.col(f"{s}_{c}").alias(c) for c in ("pos", "cigar", "ref_len")))
    return side("m"), side("o")


def links_with_bridge(marker_minis: DataFrame, mini_genomes: DataFrame) -> DataFrame:
    """marker, genome, n: links of markers to the genomes that their bridges were given to.  marker_minis: marker, mini, n;
    mini_genomes: mini, genome."""
    return marker_minis.join(mini_genomes.select("mini", "genome"), "mini").groupBy("marker", "genome").agg(F.sum("n").alias("n"))


def gap_fill_stats(marker_minis: DataFrame, genome_minis: DataFrame, min_links: int = 3, balance: float = 0.3, of_best: float = 0.5, of_own: float = 0.5) -> DataFrame:
    """marker, genome, marker_n, contig_n: the older bridge.  Of counts of min_links or more, a bridge stays if its best marker and best
    genome count are alike (`balance`), and its members if they have `of_best` of the bridge's and `of_own` of their own best count."""

    def side(df: DataFrame, key: str) -> DataFrame:
        g = df.filter(F.col("n") >= min_links)
        g = g.withColumn("own", F.max("n").over(Window.partitionBy(key))).withColumn("top", F.max("n").over(Window.partitionBy("mini")))
        g = g.filter((F.col("n") >= F.col("top") * of_best) & (F.col("n") >= F.col("own") * of_own))
        return g.select("mini", key, F.col("n").alias(f"{key}_n"), F.col("top").alias(f"{key}_top"))

    both = side(marker_minis, "marker").join(side(genome_minis, "genome"), "mini")
    both = both.filter(F.least("marker_top", "genome_top") / F.greatest("marker_top", "genome_top") >= balance)
    return both.groupBy("marker", "genome").agg(F.sum("marker_n").alias("marker_n"), F.sum("genome_n").alias("contig_n"))


def paired_clip_combine(paired: DataFrame, clipped: DataFrame) -> DataFrame:
    """marker, genome, paired, clipped: counts of both kinds for pairs that have some of the first.  Both inputs: marker, genome, n."""
    a, b = paired.withColumnRenamed("n", "paired"), clipped.withColumnRenamed("n", "clipped")
    return a.join(b, ["marker", "genome"], "full_outer").fillna(0, ["paired", "clipped"]).filter("paired > 0")


def union_rounds(**rounds: DataFrame) -> DataFrame:
    """marker, genome, n, round of the given rounds of links."""
    return reduce(DataFrame.unionByName, (df.select("marker", "genome", "n", F.lit(name).alias("round")) for name, df in rounds.items()))


def union_flanking_reads(*hits: DataFrame, within: int = 50) -> DataFrame:
    """read_base of the reads that lie within so many bases of the start of a reference in any of hits, once each."""
    return reduce(DataFrame.union, (h.filter(F.col("pos") <= within).select("read_base") for h in hits)).distinct()


def unrecovered(items: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Items (markers or genomes) without a link."""
    return items.select(key).distinct().join(found.select(key), key, "left_anti")


def gained_genomes(found: DataFrame, contigs: DataFrame, features: DataFrame, min_len: int = 1200) -> DataFrame:
    """Linked genomes that have no feature of min_len or more of their own."""
    long = features.filter(F.col("r") - F.col("l") + 1 >= min_len).select("contig").distinct()
    return found.select("genome").distinct().join(contigs.join(long, "contig").select("genome").distinct(), "genome", "left_anti")


def edge_totals(reads: DataFrame) -> DataFrame:
    """level, a, b, n: reads on each marker-contig and each contig-genome edge.  reads: read_base, marker, contig, genome."""
    level = lambda name, a, b: reads.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.countDistinct("read_base").alias("n")).select(F.lit(name).alias("level"), "a", "b", "n")
    return level("marker-contig", "marker", "contig").unionByName(level("contig-genome", "contig", "genome"))


def links_by_contig(accepted: DataFrame, contigs: DataFrame, **rounds: DataFrame) -> DataFrame:
    """marker, genome, contig and a count for each round: the contigs (or bridges) behind accepted genome links.

    accepted: marker, genome; rounds: marker, contig, n each; contigs: contig, genome.  Contigs without a link in any round are left out."""
    names = list(rounds)
    one = lambda name, df: df.select("marker", "contig", *(F.col("n").alias(x) if x == name else F.lit(0).cast("long").alias(x) for x in names))
    counts = reduce(DataFrame.unionByName, (one(name, df) for name, df in rounds.items()))
    counts = counts.groupBy("marker", "contig").agg(*(F.sum(x).alias(x) for x in names))
    return counts.join(contigs.select("contig", "genome"), "contig").join(accepted.select("marker", "genome").distinct(), ["marker", "genome"], "left_semi").select("marker", "genome", "contig", *names)


def marker_domain(markers: DataFrame, hits: DataFrame, default: str = "Bacteria") -> DataFrame:
    """marker, domain: the first rank of the best hit's taxonomy.  hits: marker, taxon, bitscore, ord."""
    best = assign.best_hit_per_query(hits, "marker")
    return markers.select("marker").join(best.select("marker", "taxon"), "marker", "left").select("marker", F.coalesce(F.nullif(F.trim(F.element_at(F.split("taxon", ";"), 1)), F.lit("")), F.lit(default)).alias("domain"))


# ---------------------------------------------------------------- from alignments to genomes


def clip_shares(left: DataFrame, right: DataFrame, contigs: DataFrame) -> DataFrame:
    """marker, genome, clip_l, clip_r: percentages of clipped alignments on both sides of a marker's links to a genome."""
    keys = ["marker", "genome"]
    at = lambda df: links.side_stats(df.join(contigs.select("contig", "genome"), "contig"), keys).select(*keys, "clip_pct")
    return at(left).withColumnRenamed("clip_pct", "clip_l").join(at(right).withColumnRenamed("clip_pct", "clip_r"), keys)


def first_round(markers: DataFrame, contigs: DataFrame, genomes: DataFrame, min_reads: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(by contig, by genome, left, right): counts of links that pass the quality rules, and the alignments behind all links.
    markers and contigs are qualified pairs; genomes: contig, genome."""
    left, right = links.link_sides(cut(links.link_reads_rd1(markers, contigs, genomes, hits=True), "sides"))
    passed = links.link_qc_rd1(left, right, ["marker", "contig"], min_reads).filter("passed")
    by_contig = cut(passed.select("marker", "contig", F.col("reads_l").alias("n")), "links")
    return by_contig, links.genome_link_counts(by_contig, genomes), left, right


def second_round(markers: DataFrame, contigs: DataFrame, minis: DataFrame, genomes: DataFrame, min_reads: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marker_minis, mini_genomes, by genome): links of markers and bridges, the genome of each bridge, and their composition.
    markers, contigs and minis are qualified pairs."""
    l, r = link_reads_mini(minis, contigs, "contig")
    to_contig = links.link_qc_mini_contig(l, r, ["mini", "contig"], min_reads).filter("passed").select("mini", "contig", F.col("reads_l").alias("n"))
    to_genome = to_contig.join(genomes.select("contig", "genome"), "contig").groupBy("mini", "genome").agg(F.sum("n").alias("n"))
    mini_genomes = cut(assign.greedy_assign_mini(to_genome, "mini", "genome", min_reads), "bridges")
    l, r = link_reads_mini(minis, markers, "marker", opposite_mate=True)
    marker_minis = cut(links.link_qc_mini_marker(l, r, ["mini", "marker"], min_reads).filter("passed").select("marker", "mini", F.col("reads_l").alias("n")), "links")
    return marker_minis, mini_genomes, links_with_bridge(marker_minis, mini_genomes)


def link_markers(
    marker_aln: DataFrame, contig_aln: DataFrame, mini_aln: DataFrame | None, genomes: DataFrame, lengths: DataFrame, ident: DataFrame,
    mismatch_cutoff: float = 2.0, min_aligned: int = 45, min_links: int = 9, min_reads: int = 3, cutoff: float = 99.0, share: float = 80.0, aligned_pct: float | None = None,
) -> DataFrame:
    """marker, genome, n, round: the whole way from alignments to the genomes that markers are given to.

    Round 1 links markers and contigs by read pairs, checks the links, sums them by genome and assigns greedily.  Round 2 takes reads that
    touch no linked marker or genome, links what is left through bridges (mini_aln: alignments to assembled bridges; without it there is
    one round only) and assigns by the simpler rule.  Alignments: read_base, mate, ref_id, ref_len, pos, cigar; genomes: contig, genome;
    lengths: marker, ref_len; ident: a, b, iden.  aligned_pct, if given, is the least percentage of a read that must be aligned."""
    m = cut(pairs.qualify_pairs(marker_aln, mismatch_cutoff, min_aligned, aligned_pct=aligned_pct), "pairs")
    c = cut(pairs.qualify_pairs(contig_aln, mismatch_cutoff, min_aligned, use_ref_min=False, aligned_pct=aligned_pct), "pairs")
    _, by_genome, left, right = first_round(m, c, genomes, min_reads)
    rd1 = cut(assign.greedy_assign(by_genome, lengths, ident, clip_shares(left, right, genomes), cutoff, min_links, share), "round1")
    if mini_aln is None:
        return union_rounds(Rd1=rd1)
    done_markers = rd1.select(F.col("marker").alias("ref_id")).distinct()
    done_contigs = genomes.join(rd1.select("genome").distinct(), "genome", "left_semi").select(F.col("contig").alias("ref_id"))
    free_m, free_c = pairs.drop_reads_touching(m, done_markers), pairs.drop_reads_touching(c, done_contigs)
    x = cut(pairs.qualify_pairs(mini_aln, mismatch_cutoff, min_aligned, use_ref_min=False, aligned_pct=aligned_pct), "pairs")
    _, _, by_genome2 = second_round(free_m, free_c, x, genomes, min_reads)
    rd2 = assign.greedy_assign_simple(by_genome2, ident, cutoff, min_links, share, min_links)
    return union_rounds(Rd1=rd1, Rd2=rd2)
