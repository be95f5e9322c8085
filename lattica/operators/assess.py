"""Assessment of links against known clusters and taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cigar import percent


def genome_to_cluster(hits: DataFrame, min_iden: float = 99.5, min_len: int = 1500, least_total: int = 524_288) -> DataFrame:
    """(genome, cluster): reference clusters that good hits cover by least_total bases.  hits: genome, cluster, ref, iden, aln_len."""
    good = hits.filter((F.col("iden") >= min_iden) & (F.col("aln_len") > min_len))
    return good.groupBy("genome", "ref", "cluster").agg(F.sum("aln_len").alias("total")).filter(F.col("total") >= least_total).select("genome", "cluster").distinct()


def marker_to_cluster(hits: DataFrame, min_iden: float = 99.5, min_len: int = 500, min_cover: float = 70) -> DataFrame:
    good = hits.filter((F.col("iden") >= min_iden) & (F.col("aln_len") > min_len) & (F.col("aln_len") * 100 >= F.col("qlen") * min_cover))
    return good.select("marker", "cluster").distinct()


def assess_links(links: DataFrame, markers: DataFrame, genomes: DataFrame) -> DataFrame:
    """links with `verdict`: Correct if marker and genome share a cluster, Wrong if both are known and share none, else Unknown."""
    m = markers.groupBy("marker").agg(F.collect_set("cluster").alias("__m"))
    g = genomes.groupBy("genome").agg(F.collect_set("cluster").alias("__g"))
    both = links.join(m, "marker", "left").join(g, "genome", "left")
    verdict = F.when(F.arrays_overlap("__m", "__g"), "Correct").when(F.col("__m").isNotNull() & F.col("__g").isNotNull(), "Wrong").otherwise("Unknown")
    return both.withColumn("verdict", verdict).drop("__m", "__g")


def genome_verdict() -> Column:
    """Of a genome's links (in an aggregate): one verdict, or Ambiguous if right and wrong ones meet."""
    right, wrong = F.max((F.col("verdict") == "Correct").cast("int")), F.max((F.col("verdict") == "Wrong").cast("int"))
    return F.when((right == 1) & (wrong == 1), "Ambiguous").when(right == 1, "Correct").when(wrong == 1, "Wrong").otherwise("Unknown")


def link_accuracy(assessed: DataFrame) -> DataFrame:
    """n, right, wrong, and accuracy weighted by reads, of known links."""
    w = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    return assessed.agg(F.countDistinct("marker").alias("markers"), w("Correct").alias("right"), w("Wrong").alias("wrong"), percent(w("Correct"), w("Correct") + w("Wrong")).alias("accuracy"))


def genome_accuracy(assessed: DataFrame) -> DataFrame:
    g = assessed.groupBy("genome").agg(genome_verdict().alias("v"))
    c = lambda v: F.count_if(F.col("v") == v)
    return g.agg(F.count("*").alias("genomes"), c("Correct").alias("right"), c("Wrong").alias("wrong"), c("Ambiguous").alias("ambiguous"), c("Unknown").alias("unknown"), percent(c("Correct"), c("Correct") + c("Wrong") + c("Ambiguous")).alias("accuracy"))


def assess_rollup(assessed: DataFrame, total_genomes: int) -> DataFrame:
    """Per round and in total: links and genomes by verdict, recovery, accuracy.  One expansion of the rows (round, total)."""
    both = assessed.withColumn("round", F.explode(F.array(F.col("round"), F.lit("total"))))
    n = both.groupBy("round").agg(*(F.count_if(F.col("verdict") == v).alias(f"links_{v.lower()}") for v in ("Correct", "Wrong", "Unknown")))
    g = both.groupBy("round", "genome").agg(genome_verdict().alias("v")).groupBy("round").agg(F.count("*").alias("genomes"), *(F.count_if(F.col("v") == v).alias(f"genomes_{v.lower()}") for v in ("Correct", "Wrong", "Ambiguous")))
    return n.join(g, "round").withColumn("recovery", percent(F.col("genomes"), F.lit(total_genomes)))


def taxon_rank_accuracy(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """rank, right, wrong, unknown: ranks of two `;`-separated taxonomies, compared from the top.  A blank rank of the left one is unknown;
    a mismatch makes all ranks below wrong."""
    p = pairs.withColumn("__id", F.xxhash64(*pairs.columns))
    z = F.arrays_zip(F.split(left, ";").alias("a"), F.split(right, ";").alias("b"))
    # the fold carries "wrong so far" down the ranks within the row: no shuffle
    start = F.struct(F.lit(False).alias("w"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        blank = F.coalesce(F.trim(x["a"]), F.lit("")) == ""
        wrong = acc["w"] | (~blank & (x["a"] != x["b"]))
        v = F.when(acc["w"], "wrong").when(blank, "unknown").when(wrong, "wrong").otherwise("right")
        return F.struct(wrong.alias("w"), F.concat(acc["out"], F.array(v)).alias("out"))

    v = p.select(F.posexplode(F.aggregate(z, start, step, lambda a: a["out"])).alias("rank", "v"))
    return v.groupBy("rank").agg(*(F.count_if(F.col("v") == x).alias(x) for x in ("right", "wrong", "unknown")))


def expected_copy_number(genomes: DataFrame, refs: DataFrame) -> DataFrame:
    """Mean copy number over the references of a genome's clusters.  genomes: genome, cluster; refs: cluster, copies.

    References are summed by cluster before they meet the genomes, so a genome has a row for each of its clusters, not for each reference."""
    known = F.col("copies").isNotNull()
    sums = refs.groupBy("cluster").agg(F.sum("copies").alias("s"), F.count_if(known).alias("n"))
    mean = F.sum("s") / F.nullif(F.sum("n"), F.lit(0))
    return genomes.distinct().join(sums, "cluster").groupBy("genome").agg(mean.alias("copies"))


def genomes_with_marker(genomes: DataFrame, markers: DataFrame) -> DataFrame:
    return genomes.join(markers.select("cluster").distinct(), "cluster", "left_semi").select("genome").distinct()


def genome_report(contigs: DataFrame, links: DataFrame, features: DataFrame, lengths: DataFrame, depths: DataFrame | None = None, completeness: DataFrame | None = None, taxa: DataFrame | None = None) -> DataFrame:
    """A row for each genome of contigs, with defaults: contigs, bases, depth (0), own (features on its contigs, 0), own_len (the
    longest, 0), completeness (0), linked (markers, 0), linked_lens (of linked markers, longest first, `;` between), best (marker of
    the most reads, NA) and taxon (unknown).  lengths: marker, ref_len; the other tables have genome and the column of their name."""
    none = lambda df, col, kind: contigs.sparkSession.createDataFrame([], f"genome string, {col} {kind}") if df is None else df.select("genome", col)
    g = contigs.groupBy("genome").agg(F.count("*").alias("contigs"), F.sum("ref_len").alias("bases"))
    f = features.join(contigs.select("contig", "genome"), "contig").groupBy("genome").agg(F.count("*").alias("own"), F.max(F.col("r") - F.col("l") + 1).alias("own_len"))
    best = F.max_by("marker", F.struct("n", "marker"))
    lens = F.array_join(F.reverse(F.array_sort(F.collect_list("ref_len"))), ";")
    k = links.join(lengths.select("marker", "ref_len"), "marker", "left").groupBy("genome").agg(F.count("*").alias("linked"), lens.alias("linked_lens"), best.alias("best"))
    out = g.join(f, "genome", "left").join(k, "genome", "left")
    for df, col, kind in ((depths, "depth", "double"), (completeness, "completeness", "double"), (taxa, "taxon", "string")):
        out = out.join(none(df, col, kind), "genome", "left")
    default = {"depth": 0.0, "own": 0, "own_len": 0, "completeness": 0.0, "linked": 0, "linked_lens": "", "best": "NA", "taxon": "unknown"}
    return out.select("genome", "contigs", "bases", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()))


def rank_within(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
