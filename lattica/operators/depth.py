"""Depth of coverage: per base, trimmed means, GC bias."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar as C
from ..functions.cigar import percent
from .groups import cut


TILE = 100_000  # positions of a reference that one task's window holds


def depth_runs(aln: DataFrame, refs: DataFrame, tile: int = TILE) -> DataFrame:
    """ref_id, start, end, depth: runs of one depth that cover each position of each reference once, zeros included.

    A reference is cut into tiles and an alignment at their borders (insertions aside, at the reference's end too), so each tile is summed by
    itself: a piece adds one at its start and takes one behind its end.  Sums over positions come first, so a running sum sees one row a position at
    most, however deep it is, and a long reference is many tasks.  Runs end with their tile."""
    spans = aln.filter(C.is_mapped(F.col("cigar")))
    if "ref_len" not in aln.columns:
        spans = spans.join(refs.select("ref_id", "ref_len"), "ref_id")
    last = F.least(F.col("pos") + C.aligned_length(F.col("cigar"), include_ins=False) - 1, F.col("ref_len"))
    spans = spans.select("ref_id", F.col("ref_len").cast("int").alias("ref_len"), F.greatest(F.col("pos"), F.lit(1)).cast("int").alias("l"), last.cast("int").alias("r")).filter("l <= r")
    tile_of = lambda p: F.floor((p - 1) / tile).cast("int")
    pieces = spans.select("ref_id", "ref_len", "l", "r", F.explode(F.sequence(tile_of(F.col("l")), tile_of(F.col("r")))).alias("t"))
    border = lambda t: ((t + 1) * tile).cast("int")
    end = F.least(F.col("r"), border(F.col("t")))
    ends = F.array(F.struct(F.greatest(F.col("l"), border(F.col("t") - 1) + 1).alias("pos"), F.lit(1).alias("d")), F.when(end < F.least(border(F.col("t")), F.col("ref_len")), F.struct((end + 1).alias("pos"), F.lit(-1).alias("d"))))
    events = pieces.select("ref_id", "ref_len", "t", F.explode(F.array_compact(ends)).alias("e")).select("ref_id", "ref_len", "t", "e.pos", "e.d")
    # every tile has its start, whatever is aligned to it
    tiles = refs.select("ref_id", F.col("ref_len").cast("int").alias("ref_len"), F.explode(F.sequence(F.lit(0), tile_of(F.col("ref_len")))).alias("t"))
    events = events.unionByName(tiles.select("*", (border(F.col("t") - 1) + 1).alias("pos"), F.lit(0).alias("d")))
    sums = events.groupBy("ref_id", "ref_len", "t", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("ref_id", "t").orderBy("pos")
    return sums.select("ref_id", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w) - 1, F.least(border(F.col("t")), F.col("ref_len"))).alias("end"), F.sum("d").over(w).alias("depth"))


def depth_by_base(aln: DataFrame, refs: DataFrame, tile: int = TILE) -> DataFrame:
    """ref_id, pos, depth for each position of each reference, zeros included: the runs of depth_runs, spread out where they are."""
    return spread_runs(depth_runs(aln, refs, tile))


def spread_runs(runs: DataFrame) -> DataFrame:
    return runs.select("ref_id", F.explode(F.sequence("start", "end")).alias("pos"), "depth")


def trimmed_mean_depth(depth: DataFrame, lengths: DataFrame, ends: int = 150, share: int = 25, tile: int = TILE) -> DataFrame:
    """Mean depth of each reference without its ends and without a share of the lowest and of the highest positions.  depth: ref_id, pos,
    depth, or the runs of depth_runs with the same tile.

    k = round(n * share / 100), half to even.  low_cut and high_cut are the k-th lowest and highest depths; by position, the first k
    positions at or below low_cut and the first k at or above high_cut go.  A position at both cuts
    (they are equal) uses up both quotas.

    Nothing is sorted by depth or over a whole reference: positions are counted by (reference, tile, depth); the cuts come from the counts, and
    counts of low and high positions carried from tile to tile say where the quotas end.  Only the tiles in which one ends, two for a reference at
    most, are read by position; for the others the counts are enough."""
    runs = depth if "start" in depth.columns else depth.select("ref_id", F.col("pos").alias("start"), F.col("pos").alias("end"), "depth")
    runs = runs.withColumn("t", F.floor((F.col("start") - 1) / tile)).join(lengths.select("ref_id", "ref_len"), "ref_id")
    runs = runs.select("ref_id", "t", "depth", F.greatest(F.col("start"), F.lit(ends + 1)).alias("start"), F.least(F.col("end"), F.col("ref_len") - ends).alias("end")).filter(F.col("start") <= F.col("end"))
    counts = cut(runs.groupBy("ref_id", "t", "depth").agg(F.sum(F.col("end") - F.col("start") + 1).alias("c")), "depth-counts")
    own = Window.partitionBy("ref_id").orderBy("depth")
    by_depth = counts.groupBy("ref_id", "depth").agg(F.sum("c").alias("c")).withColumns({"n": F.sum("c").over(Window.partitionBy("ref_id")), "up": F.sum("c").over(own)})
    k = F.bround(F.col("n") * share / 100, 0).cast("long")
    reaches = F.when((k > 0) & (F.col("up") >= k), F.col("depth")), F.when((k > 0) & (F.col("n") - F.col("up") + F.col("c") >= k), F.col("depth"))
    cuts = by_depth.groupBy("ref_id").agg(F.max(k).alias("k"), F.min(reaches[0]).alias("low_cut"), F.max(reaches[1]).alias("high_cut"))

    low, high = F.coalesce(F.col("depth") <= F.col("low_cut"), F.lit(False)), F.coalesce(F.col("depth") >= F.col("high_cut"), F.lit(False))
    judged = counts.join(cuts, "ref_id").withColumns({"low": low, "high": high})
    tiles = judged.groupBy("ref_id", "t").agg(F.first("k").alias("k"), F.first("low_cut").alias("low_cut"), F.first("high_cut").alias("high_cut"), *(F.sum(F.when(F.col(x), F.col("c")).otherwise(0)).alias(f"{x}s") for x in ("low", "high")))
    run = Window.partitionBy("ref_id").orderBy("t")
    tiles = tiles.withColumns({f"{x}s_before": F.sum(f"{x}s").over(run) - F.col(f"{x}s") for x in ("low", "high")})
    ends_here = lambda x: (F.col(f"{x}s_before") < F.col("k")) & (F.col(f"{x}s_before") + F.col(f"{x}s") > F.col("k"))
    tiles = cut(tiles.withColumn("split", ends_here("low") | ends_here("high")), "depth-tiles")

    # whole tiles: a quota takes all of its positions or none
    whole = judged.select("ref_id", "t", "depth", "c", "low", "high").join(tiles.filter("not split"), ["ref_id", "t"])
    gone = (F.col("low") & (F.col("lows_before") < F.col("k"))) | (F.col("high") & (F.col("highs_before") < F.col("k")))
    whole = whole.filter(~gone).groupBy("ref_id").agg(F.sum("c").alias("counted"), F.sum(F.col("c") * F.col("depth")).alias("total"))
    w = Window.partitionBy("ref_id", "t").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    part = runs.join(tiles.filter("split").drop("lows", "highs"), ["ref_id", "t"]).withColumn("pos", F.explode(F.sequence("start", "end")))
    part = part.withColumns({"lows": F.sum(low.cast("int")).over(w) + F.col("lows_before"), "highs": F.sum(high.cast("int")).over(w) + F.col("highs_before")})
    gone = (low & (F.col("lows") <= F.col("k"))) | (high & (F.col("highs") <= F.col("k")))
    part = part.filter(~gone).groupBy("ref_id").agg(F.count("*").alias("counted"), F.sum("depth").alias("total"))
    sums = whole.unionByName(part).groupBy("ref_id").agg(F.sum("counted").alias("counted"), F.sum("total").alias("total"))
    n = F.col("counted")
    return cuts.join(sums, "ref_id", "left").select("ref_id", "low_cut", "high_cut", F.coalesce(n, F.lit(0)).alias("counted"), (F.floor((F.col("total") * 200 + n) / (n * 2)) / 100).alias("mean_depth"))


def gc_bias_profile(depth: DataFrame, seqs: DataFrame, window: int = 100, ends: int = 500, min_len: int = 10_000, most_n: int = 4, tile: int = TILE, mask: DataFrame | None = None) -> DataFrame:
    """genome, gc, cov, n, prop: windows of each genome by GC percentage.  seqs: genome, ref_id, seq.

    A sequence is cut into tiles that overlap by a window, so that a long contig is several tasks.  A tile meets its depths once, and prefix
    sums over its bases give the depth, GC and unknown bases of all of its windows in a few passes over arrays; what leaves it is a row for each GC
    percentage.  Windows that start or end in `mask` (contig and pos, or contig, l and r: see feature_mask_spans) are left out."""
    s = seqs.filter(F.length("seq") >= min_len).select("genome", "ref_id", F.length("seq").alias("len"), "seq")
    # tiles are cut before rows multiply, so that no row carries the whole sequence
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / tile).cast("int")), lambda t: F.struct(t.alias("t"), F.substring(F.col("seq"), t * tile + 1, F.lit(tile + window - 1)).alias("seq")))
    s = s.select("genome", "ref_id", "len", F.explode(tiles).alias("c")).select("genome", "ref_id", "len", "c.t", "c.seq")
    # what a tile holds: positions and their depths, ends of masked spans; a position near its tile's start is in the tile before as well
    tile_of = lambda p: F.floor((p - 1) / tile).cast("int")
    reach = lambda l, r: F.explode(F.sequence(F.greatest(tile_of(l - (window - 1)), F.lit(0)), tile_of(r))).alias("t")
    pairs = lambda a, b, of: F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias(of)
    split = lambda of, a, b: (F.col(f"{of}.a").alias(a), F.col(f"{of}.b").alias(b))
    deep = depth.select("ref_id", F.col("pos").cast("int").alias("pos"), F.col("depth").cast("long").alias("depth"), reach(F.col("pos"), F.col("pos")))
    deep = deep.groupBy("ref_id", "t").agg(pairs("pos", "depth", "d")).select("ref_id", "t", *split("d", "pos", "depth"))
    s = s.join(deep, ["ref_id", "t"], "left")
    if mask is None:
        s = s.withColumns({"l": F.lit(None).cast("array<int>"), "r": F.lit(None).cast("array<int>")})
    else:
        at = (F.col("pos"), F.col("pos")) if "pos" in mask.columns else (F.col("l"), F.col("r"))
        m = mask.select(F.col("contig").alias("ref_id"), at[0].cast("int").alias("l"), at[1].cast("int").alias("r")).select("*", reach(F.col("l"), F.col("r")))
        s = s.join(m.groupBy("ref_id", "t").agg(pairs("l", "r", "m")).select("ref_id", "t", *split("m", "l", "r")), ["ref_id", "t"], "left")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[window:] - c[:-window]
        for b in batches:
            genomes, percents, depths = [], [], []
            for genome, length, t, seq, at, d, left, right in b[["genome", "len", "t", "seq", "pos", "depth", "l", "r"]].itertuples(index=False):
                n, first = len(seq) - window + 1, int(t) * tile + 1
                if n < 1:
                    continue
                base = np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8)
                deep, masked = np.zeros(len(seq), np.int64), np.zeros(len(seq), bool)
                if at is not None:
                    fine = (at >= first) & (at < first + len(seq))
                    deep[at[fine] - first] = d[fine]
                for x, y in zip(left, right, strict=True) if left is not None else ():
                    masked[max(x - first, 0) : max(y - first + 1, 0)] = True
                pos = first + np.arange(n)
                inside = (sums(base == 78) <= most_n) & (pos > ends) & (pos + window - 1 <= length - ends) & (pos < first + tile) & ~masked[:n] & ~masked[window - 1 :]
                percents.append(sums((base == 71) | (base == 67))[inside] * 100 // window)
                depths.append(sums(deep)[inside])
                genomes.append(np.full(len(percents[-1]), len(genomes)))
            if genomes:
                own = pd.DataFrame({"at": np.concatenate(genomes), "gc": np.concatenate(percents), "s": np.concatenate(depths)})
                own["genome"] = b["genome"].to_numpy()[[i for i, seq in enumerate(b["seq"]) if len(seq) >= window]][own["at"]]
                yield own.groupby(["genome", "gc"], as_index=False, dropna=False).agg(s=("s", "sum"), n=("s", "size"))

    kind = seqs.schema["genome"].dataType.simpleString()
    parts = s.mapInPandas(windows, f"genome {kind}, gc int, s long, n long")
    k = parts.groupBy("genome", "gc").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("genome"))
    return k.select("genome", "gc", (F.col("s") / (F.col("n") * window)).alias("cov"), "n", (F.floor(F.col("n") * 10000 / total + 0.5) / 10000).alias("prop"))


def genome_mean_depth(profile: DataFrame, subsample_percent: float = 100) -> DataFrame:
    """Mean depth over all windows of a genome, rescaled for subsampled reads by round(100 / percent)."""
    scale = round(100 / subsample_percent)
    return profile.groupBy("genome").agg((F.sum(F.col("cov") * F.col("n")) / F.sum("n") * scale).alias("depth"))


def genome_depth_weighted(contigs: DataFrame) -> DataFrame:
    """Length-weighted contig depth.  contigs: genome, ref_len, depth."""
    return contigs.groupBy("genome").agg((F.sum(F.col("ref_len") * F.col("depth")) / F.sum("ref_len")).alias("depth"))


def gc_normalised_depth(markers: DataFrame, profile: DataFrame) -> DataFrame:
    """markers: marker, genome, depth, gc_marker, gc_genome.  The depth, divided by the ratio of the genome's coverage at the marker's
    GC and at its own; null where a bucket is missing."""
    at = lambda s: profile.select("genome", F.col("gc").alias(f"__gc_{s}"), F.col("cov").alias(f"__cov_{s}"))
    m = markers.withColumns({"__m": F.bround("gc_marker", 0).cast("int"), "__g": F.bround("gc_genome", 0).cast("int")})
    m = m.join(at("m").withColumnRenamed("__gc_m", "__m"), ["genome", "__m"], "left").join(at("g").withColumnRenamed("__gc_g", "__g"), ["genome", "__g"], "left")
    ratio = F.col("__cov_m") / F.nullif(F.col("__cov_g"), F.lit(0.0))
    return m.select("marker", "genome", "depth", (F.col("depth") / F.nullif(ratio, F.lit(0.0))).alias("depth_norm"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """contig, l, r: the union of closed intervals, touching ones joined, by a running maximum of their ends."""
    w = Window.partitionBy("contig").orderBy("l", "r")
    s = spans.select("contig", "l", "r").withColumn("reach", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.coalesce((F.col("l") > F.col("reach") + 1).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("contig", "island").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("island")


def depth_in_features(depth: DataFrame, features: DataFrame, bin_size: int = 1000) -> DataFrame:
    """depth rows within a feature (contig, l, r), once each.

    Features are united, and a span is indexed by bins of the narrowest width bin_size * 8 ** i that is not shorter than itself: two rows at most,
    however long it is.  A position looks into one bin of each width that occurs, so the join is an equi-join on (contig, width, bin), then the range."""
    level = F.greatest(F.ceil(F.log2((F.col("r") - F.col("l") + 1) / bin_size) / 3), F.lit(0)).cast("int")
    spans = merged_spans(features).filter("l <= r").withColumn("level", level)
    at = lambda p, i: F.floor(p / (bin_size * F.pow(F.lit(8), i)))
    bins = spans.select(F.col("contig").alias("__c"), "l", "r", F.col("level").alias("__i"), F.explode(F.array_distinct(F.array(at(F.col("l"), F.col("level")), at(F.col("r"), F.col("level"))))).alias("__b"))
    levels = sorted(r[0] for r in spans.select("level").distinct().collect())  # widths that occur: a dozen at most
    if not levels:
        return depth.limit(0)
    d = depth.withColumn("__l", F.explode(F.array(*map(F.lit, levels)))).withColumn("__b", at(F.col("pos"), F.col("__l")))
    hit = (F.col("ref_id") == F.col("__c")) & (F.col("__l") == F.col("__i")) & (d["__b"] == bins["__b"]) & F.col("pos").between(F.col("l"), F.col("r"))
    return d.join(bins, hit, "left_semi").drop("__b", "__l")


def feature_mask_spans(features: DataFrame, before: int = 100) -> DataFrame:
    """contig, l, r: the union of spans from `before` in front of a feature (1 at least) to its end."""
    return merged_spans(features.select("contig", F.greatest(F.lit(1), F.col("l") - before).alias("l"), "r").filter("l <= r"))


def feature_mask_positions(features: DataFrame, before: int = 100) -> DataFrame:
    """(contig, pos): the positions of feature_mask_spans.  The spans do not overlap, so positions need no distinct."""
    return feature_mask_spans(features, before).select("contig", F.explode(F.sequence("l", "r")).alias("pos"))


def top_n_mean_depth(depth: DataFrame, n: int = 13) -> DataFrame:
    """Mean of the n highest depths of each reference."""
    w = Window.partitionBy("ref_id").orderBy(F.desc("depth"), "pos")
    return depth.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).groupBy("ref_id").agg(F.avg("depth").alias("mean_depth"))


def consecutive_runs(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of consecutive positions as `a-b,c-d`.

    Positions are set as bits of words of 32, so repeated ones are one and 32 rows are one before they are shuffled; runs are read from the words, and gaps
    and islands join those that meet at a border of words.  Null positions are in no run."""
    words = df.filter(F.col(pos).isNotNull()).groupBy(key, F.floor(F.col(pos) / 32).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(pos), F.lit(32)).cast("int"))).alias("__bits"))
    bits, up = F.col("__bits"), F.sequence(F.lit(0), F.lit(31))
    at = lambda b: F.filter(up, lambda i: F.getbit(b, i) == 1)
    firsts, lasts = at(bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1)))), at(bits.bitwiseAND(F.bitwise_not(F.shiftright(bits, 1))))
    base = F.col("__w") * 32
    inner = words.select(key, base.alias("__base"), F.explode(F.arrays_zip(firsts.alias("a"), lasts.alias("b"))).alias("__r"))
    kind = df.schema[pos].dataType
    inner = inner.select(key, (F.col("__base") + F.col("__r.a")).cast(kind).alias("a"), (F.col("__base") + F.col("__r.b")).cast(kind).alias("b"))
    w = Window.partitionBy(key).orderBy("a")
    fresh = F.coalesce((F.lag("b").over(w) + 1 != F.col("a")).cast("int"), F.lit(1))
    runs = inner.withColumn("__new", fresh).withColumn("__g", F.sum("__new").over(w)).groupBy(key, "__g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    each = F.array_sort(F.collect_list(F.struct("a", "b")))
    return runs.groupBy(key).agg(F.array_join(F.transform(each, lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("runs"))


def band(ratio: Column, low: float = 0.85, high: float = 1.15) -> Column:
    return F.when(ratio < low, -1).when(ratio > high, 1).otherwise(0)


def optimal_copy_number(est: DataFrame) -> DataFrame:
    """est: marker, genome, depth_all, ratio_all, depth_linked, ratio_linked, genome_depth.  Depth by the variable/conserved ratios of
    all and of linked alignments, and copies.  Rows with a ratio of zero go."""
    a, b = band(F.col("ratio_all")), band(F.col("ratio_linked"))
    nearer = F.abs(F.col("ratio_linked") - 1) <= F.abs(F.col("ratio_all") - 1)
    best = (
        F.when((a == 0) & (b == 0), F.greatest("depth_all", "depth_linked"))
        .when((a < 0) & (b < 0), F.col("depth_all") * F.col("ratio_all"))
        .when((a > 0) & (b > 0), F.col("depth_all") / F.col("ratio_all"))
        .when(nearer, F.col("depth_linked") / F.col("ratio_linked"))
        .otherwise(F.col("depth_all") / F.col("ratio_all"))
    )
    out = est.filter((F.col("ratio_all") != 0) & (F.col("ratio_linked") != 0)).withColumn("best_depth", best)
    return out.select("marker", "genome", "best_depth", (F.col("best_depth") / F.nullif(F.col("genome_depth"), F.lit(0.0))).alias("copies"))


def copy_number_by_genome(copies: DataFrame, provided: DataFrame | None = None) -> DataFrame:
    """Sum over a genome's markers, beside the known number (0 if none is given)."""
    out = copies.groupBy("genome").agg(F.sum("copies").alias("copies"))
    if provided is None:
        return out
    return out.join(provided.select("genome", F.col("n").alias("known")), "genome", "left").select("genome", "copies", F.coalesce("known", F.lit(0.0)).alias("known"))


SPAN_BIN = 1000  # positions of a reference that a key of var_con_coverage's join holds


def cut_spans(df: DataFrame, start: str = "start", end: str = "end", size: int = SPAN_BIN) -> DataFrame:
    """df with `bin`: closed spans of ref_id, cut at the borders of bins of `size` positions."""
    bin_of = lambda p: F.floor((F.col(p) - 1) / size)
    d = df.withColumn("bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    return d.withColumns({start: F.greatest(F.col(start), F.col("bin") * size + 1), end: F.least(F.col(end), (F.col("bin") + 1) * size)})


def var_con_coverage(depth: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean depth over variable and over conserved positions, and their ratio.  depth: ref_id, pos, depth, or runs (start and end for
    pos), which may be cut by bins before (cut_spans); regions: ref_id, kind (v, c), and pos or a closed span l, r.

    Spans of regions and of depths meet by (reference, bin) and count by their overlap, so regions that are given as spans are not spread out.  Regions are
    hashed where they are shuffled to: Spark takes rows that it spreads out for few, and would send all of them to the driver and to every executor."""
    if "l" in regions.columns:
        d = depth if "start" in depth.columns else depth.withColumns({"start": F.col("pos"), "end": F.col("pos")})
        d = d if "bin" in d.columns else cut_spans(d)
        spans = cut_spans(regions.select("ref_id", "kind", "l", "r").filter("l <= r"), "l", "r").hint("shuffle_hash")
        d = d.select("ref_id", "bin", "start", "end", "depth").join(spans, ["ref_id", "bin"])
        d = d.withColumn("n", F.least("end", "r") - F.greatest("start", "l") + 1).filter("n > 0")
    else:
        d = depth if "start" not in depth.columns else spread_runs(depth)
        d = d.join(regions.hint("merge"), ["ref_id", "pos"]).withColumn("n", F.lit(1))
    of = lambda k: F.when((F.col("kind") == k) & F.col("depth").isNotNull(), F.col("n"))
    mean = lambda k: F.sum(of(k) * F.col("depth")).cast("double") / F.sum(of(k))
    out = d.groupBy("ref_id").agg(mean("v").alias("var"), mean("c").alias("con"))
    return out.withColumn("ratio", percent(F.col("var"), F.col("con") * 100))


def copy_numbers(
    aln: DataFrame, linked: DataFrame, refs: DataFrame, regions: DataFrame, markers: DataFrame, profile: DataFrame, links: DataFrame,
    ends: int = 150, share: int = 25, subsample_percent: float = 100, gc_correction: bool = True,
) -> DataFrame:
    """marker, genome, best_depth, genome_depth, copies: the whole way from alignments to copies of a marker in its genome.

    aln: alignments of reads to markers, linked: those of reads that link them; refs: ref_id, ref_len; regions: ref_id, kind (v, c), and pos or l, r;
    markers: marker, gc_marker; profile: gc_bias_profile of the genomes, with gc_genome; links: marker, genome.  Depths are trimmed
    means of bases, corrected for GC; all and linked alignments each have their ratio of variable to conserved depth, which decides
    between them (optimal_copy_number)."""

    def side(a: DataFrame, name: str) -> DataFrame:
        depth = cut(depth_runs(a, refs), "depth")  # read three times
        mean = trimmed_mean_depth(depth, refs, ends, share).select("ref_id", F.col("mean_depth").alias("depth"))
        ratio = var_con_coverage(depth, regions).select("ref_id", "ratio")
        out = links.join(markers, "marker").join(profile.select("genome", "gc_genome").distinct(), "genome").join(mean, F.col("marker") == F.col("ref_id")).drop("ref_id")
        if gc_correction:
            out = gc_normalised_depth(out, profile).select("marker", "genome", F.col("depth_norm").alias("depth"))
        out = out.select("marker", "genome", F.col("depth").alias(f"depth_{name}"))
        return out.join(ratio, F.col("marker") == F.col("ref_id")).select("marker", "genome", f"depth_{name}", F.col("ratio").alias(f"ratio_{name}"))

    whole = genome_mean_depth(profile, subsample_percent).withColumnRenamed("depth", "genome_depth")
    est = side(aln, "all").join(side(linked, "linked"), ["marker", "genome"]).join(whole, "genome")
    return optimal_copy_number(est).join(whole, "genome").select("marker", "genome", "best_depth", "genome_depth", "copies")
