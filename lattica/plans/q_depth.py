"""Queries of depth, GC bias, regions and copy numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import regions as G
from ..operators.groups import cut
from .registry import query
from .sqltext import op_len, pct

REFS = "refs as (select distinct ref_id, ref_len from fx_aln where side = 'marker')"
BY_BASE = f"{REFS}, grid as (select ref_id, ref_len, unnest(range(1, ref_len + 1)) as pos from refs), cover as (select ref_id, unnest(range(pos, least(pos + {op_len('cigar', 'MXmx=')}, ref_len + 1))) as pos from fx_aln where side = 'marker'), dep as (select g.ref_id, g.ref_len, g.pos, count(c.pos) as depth from grid g left join cover c on c.ref_id = g.ref_id and c.pos = g.pos group by all)"


def marker_depth(fx):
    a = fx("fx_aln").filter("side = 'marker'")
    return D.depth_by_base(a, a.select("ref_id", "ref_len").distinct())


@query("depth_by_base", "select ref_id, cast(pos as int) as pos, depth from dep", BY_BASE)
def _(fx):
    return marker_depth(fx)


TRIM = f"""{BY_BASE}, inner_d as (select *, count(*) over (partition by ref_id) as n from dep where pos > 150 and pos <= ref_len - 150),
ks as (select *, cast(round_even(n * 25 / 100.0, 0) as int) as k, row_number() over (partition by ref_id order by depth, pos) as up, row_number() over (partition by ref_id order by depth desc, pos) as down from inner_d),
cuts as (select *, max(case when up = k then depth end) over (partition by ref_id) as low_cut, max(case when down = k then depth end) over (partition by ref_id) as high_cut from ks),
runs as (select *, count(*) filter (where depth <= low_cut) over (partition by ref_id order by pos) as lows, count(*) filter (where depth >= high_cut) over (partition by ref_id order by pos) as highs from cuts)"""


@query("trimmed_mean_depth", "select ref_id, max(low_cut) as low_cut, max(high_cut) as high_cut, count(*) filter (where not dropped) as counted, floor((sum(depth) filter (where not dropped) * 200 + count(*) filter (where not dropped)) / (2 * count(*) filter (where not dropped))) / 100 as mean_depth from (select *, coalesce((depth <= low_cut and lows <= k) or (depth >= high_cut and highs <= k), false) as dropped from runs) group by ref_id", TRIM)
def _(fx):
    a = fx("fx_aln").filter("side = 'marker'")
    refs = cut(a.select("ref_id", "ref_len").distinct(), "refs")
    return D.trimmed_mean_depth(cut(D.depth_runs(a, refs), "depth"), refs)


# sequences of one genome each, and one base per position with the depth of a derived track
BASES = """bases as (select seq_id % 20 as genome, 'S' || seq_id as ref_id, length(seq) as len, i as pos, substr(seq, i, 1) as base, (seq_id * 13 + i * 7) % 60 as depth from (select *, unnest(range(1, length(seq) + 1)) as i from fx_seq)),
mask as (select distinct 'S' || seq_id as ref_id, unnest(range(greatest(1, 40 + seq_id % 7 - 10), 46 + seq_id % 7)) as pos from fx_seq where length(seq) > 100),
based as (select b.*, m.pos as masked from bases b left join mask m using (ref_id, pos)),
wins as (select genome, masked, last_value(masked) over w as last_masked, count(*) over w as full_n, sum(case when base in ('G', 'C') then 1 else 0 end) over w as gc, sum(case when base = 'N' then 1 else 0 end) over w as unknown, sum(depth) over w as s, pos, len from based window w as (partition by ref_id order by pos rows between current row and 19 following)),
prof as (select genome, cast(floor(gc * 100 / 20) as int) as gc, sum(s) / (count(*) * 20) as cov, count(*) as n from wins where full_n = 20 and unknown <= 4 and pos > 5 and pos + 19 <= len - 5 and masked is null and last_masked is null group by 1, 2)"""


def profile(fx):
    s = fx("fx_seq").select((F.col("seq_id") % 20).alias("genome"), F.concat(F.lit("S"), F.col("seq_id").cast("string")).alias("ref_id"), "seq", "seq_id")
    depth = s.select("ref_id", "seq_id", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos")).select("ref_id", "pos", ((F.col("seq_id") * 13 + F.col("pos") * 7) % 60).alias("depth"))
    found = s.filter(F.length("seq") > 100).select(F.col("ref_id").alias("contig"), (40 + F.col("seq_id") % 7).cast("int").alias("l"), (45 + F.col("seq_id") % 7).cast("int").alias("r"))
    return D.gc_bias_profile(depth, s.drop("seq_id"), window=20, ends=5, min_len=50, mask=D.feature_mask_spans(found, 10))


@query("gc_bias_profile", "select genome, gc, cov, n, floor(n * 10000 / sum(n) over (partition by genome) + 0.5) / 10000 as prop from prof", BASES)
def _(fx):
    return profile(fx)


@query("genome_mean_depth", "select genome, round(sum(cov * n) / sum(n) * 4, 6) as depth from prof group by genome", BASES)
def _(fx):
    return D.genome_mean_depth(profile(fx), 25).select("genome", F.round("depth", 6).alias("depth"))


@query("genome_depth_weighted", "select genome, sum(ref_len * (ref_len % 37)) / sum(ref_len) as depth from fx_contigs group by genome")
def _(fx):
    return D.genome_depth_weighted(fx("fx_contigs").withColumn("depth", (F.col("ref_len") % 37).cast("double")))


@query("gc_normalised_depth", "select 'M' || p.p_partkey as marker, g.genome, cast(p.p_partkey % 90 as double) as depth, round(p.p_partkey % 90 / nullif(a.cov / nullif(b.cov, 0), 0), 9) as depth_norm from part p join (select distinct genome from prof) g on g.genome = p.p_partkey % 20 left join prof a on a.genome = g.genome and a.gc = 40 + (p.p_partkey % 3) * 5 left join prof b on b.genome = g.genome and b.gc = 45", BASES)
def _(fx):
    prof = profile(fx)
    k = F.col("p_partkey")
    m = fx.table("part").select(F.concat(F.lit("M"), k.cast("string")).alias("marker"), (k % 20).alias("genome"), (k % 90).cast("double").alias("depth"), (40 + (k % 3) * 5 + 0.25).alias("gc_marker"), F.lit(44.75).alias("gc_genome"))
    m = m.join(prof.select("genome").distinct(), "genome", "left_semi")
    return D.gc_normalised_depth(m, prof).withColumn("depth_norm", F.round("depth_norm", 9))


def track(fx, parts: int = 20_000):
    """fx_depth of parts that are dealt to tasks first, `parts` to each: a row of a small file becomes some 135 positions, and what a task
    sorts or sums of them at once should not grow with the table."""
    part = fx.table("part").select("p_partkey")
    return fx.sql("select * from fx_depth", part=part.repartition(max(part.count() // parts, 1), "p_partkey"))


@query("depth_in_features", "select ref_id, pos, depth from fx_depth d where exists (select 1 from fx_features f where f.contig = d.ref_id and d.pos between f.l and f.r)")
def _(fx):
    return D.depth_in_features(fx("fx_depth"), fx("fx_features")).select("ref_id", "pos", "depth")


@query("feature_mask_positions", "select distinct contig, unnest(range(greatest(1, l - 100), r + 1)) as pos from fx_features")
def _(fx):
    return D.feature_mask_positions(fx("fx_features")).select("contig", F.col("pos").cast("long").alias("pos"))


@query("top_n_mean_depth", "select ref_id, avg(depth) as mean_depth from (select *, row_number() over (partition by ref_id order by depth desc, pos) as k from fx_depth) where k <= 13 group by 1")
def _(fx):
    return D.top_n_mean_depth(track(fx))


@query("consecutive_runs", "select ref_id, string_agg(a || '-' || b, ',' order by a) as runs from (select ref_id, min(pos) as a, max(pos) as b from (select ref_id, pos, pos - row_number() over (partition by ref_id order by pos) as g from fx_depth where depth >= 20) group by ref_id, g) group by 1")
def _(fx):
    return D.consecutive_runs(track(fx).filter("depth >= 20"), "ref_id", "pos")


EST = "est as (select 'M' || p_partkey as marker, 'G' || (p_partkey % 40) as genome, cast(p_partkey % 83 as double) as depth_all, (p_partkey % 29) * 0.0625 as ratio_all, cast(p_partkey % 71 as double) as depth_linked, (p_partkey % 23) * 0.078125 as ratio_linked, cast(5 + p_partkey % 17 as double) as genome_depth from part)"
BEST = """best as (select marker, genome, genome_depth, case
  when ratio_all between 0.85 and 1.15 and ratio_linked between 0.85 and 1.15 then greatest(depth_all, depth_linked)
  when ratio_all < 0.85 and ratio_linked < 0.85 then depth_all * ratio_all
  when ratio_all > 1.15 and ratio_linked > 1.15 then depth_all / ratio_all
  when abs(ratio_linked - 1) <= abs(ratio_all - 1) then depth_linked / ratio_linked else depth_all / ratio_all end as best_depth
from est where ratio_all <> 0 and ratio_linked <> 0)"""


def copies(fx):
    k = F.col("p_partkey")
    est = fx.table("part").select(
        F.concat(F.lit("M"), k.cast("string")).alias("marker"), F.concat(F.lit("G"), (k % 40).cast("string")).alias("genome"), (k % 83).cast("double").alias("depth_all"), ((k % 29) * 0.0625).alias("ratio_all"),
        (k % 71).cast("double").alias("depth_linked"), ((k % 23) * 0.078125).alias("ratio_linked"), (5 + k % 17).cast("double").alias("genome_depth"),
    )
    return D.optimal_copy_number(est)


@query("optimal_copy_number", "select marker, genome, best_depth, best_depth / genome_depth as copies from best", f"{EST}, {BEST}")
def _(fx):
    return copies(fx)


@query("copy_number_by_genome", "select genome, round(sum(best_depth / genome_depth), 6) as copies, cast(case when cast(substr(genome, 2) as int) % 3 = 0 then cast(substr(genome, 2) as int) % 7 else 0 end as double) as known from best group by genome", f"{EST}, {BEST}")
def _(fx):
    c = copies(fx)
    g = F.substring("genome", 2, 9).cast("int")
    known = c.select("genome").distinct().filter(g % 3 == 0).withColumn("n", (g % 7).cast("double"))
    return D.copy_number_by_genome(c, known).withColumn("copies", F.round("copies", 6))


@query("sink_cn_tables", "select genome, cast(round(sum(best_depth / genome_depth), 3) as double) as n from best group by genome", f"{EST}, {BEST}")
def _(fx):
    from ..sources import readers as R

    out = D.copy_number_by_genome(copies(fx)).select("genome", F.round("copies", 3).alias("n"))
    return R.read_provided_cn(fx.spark, R.stored(out, R.write_tsv, "cn"))


# ---------------------------------------------------------------- regions

ALL = """vs as (select *, lag(r) over (partition by seq_id order by v) as before from fx_regions),
con0 as (select seq_id, ref_len, v * 2 - 1 as ord, case when v = 1 then 1 else before + 1 end as l, l - 1 as r from vs union all select seq_id, ref_len, 19, r + 1, ref_len from fx_regions where v = 9),
con as (select seq_id, ref_len, ord, 'c' as kind, case when r - l >= 1 then l end as l, case when r - l >= 1 then r end as r from con0),
spans as (select * from con union all select seq_id, ref_len, v * 2, 'v', l, r from fx_regions),
trims as (select seq_id, ref_len, ord, kind, greatest(l + cast(floor((r - l + 1) * 0.25) as int), 201) as l, least(r - cast(floor((r - l + 1) * 0.25) as int), ref_len - 200) as r, l as l0, r as r0 from spans),
trim as (select seq_id, ref_len, ord, kind, case when l0 is not null and r0 is not null and r - l + 1 >= 25 then l end as l, case when l0 is not null and r0 is not null and r - l + 1 >= 25 then r end as r from trims),
flank as (select seq_id, ref_len, ord, kind, case when a or b then l end as l, case when a or b then r end as r from (select *, lag(l) over w is not null as a, lead(l) over w is not null as b from trim window w as (partition by seq_id order by ord)))"""


@query("conserved_regions", "select seq_id, ord, cast(l as double) as l, cast(r as double) as r from con", ALL)
def _(fx):
    return G.conserved_regions(fx("fx_regions")).select("seq_id", "ord", *(F.col(c).cast("double").alias(c) for c in "lr"))


@query("trim_regions", "select seq_id, ord, kind, cast(l as double) as l, cast(r as double) as r from trim", ALL)
def _(fx):
    return G.trim_regions(G.all_regions(fx("fx_regions"))).select("seq_id", "ord", "kind", *(F.col(c).cast("double").alias(c) for c in "lr"))


@query("flank_filter", "select seq_id, ord, kind, cast(l as double) as l, cast(r as double) as r from flank", ALL)
def _(fx):
    return G.flank_filter(G.trim_regions(G.all_regions(fx("fx_regions")))).select("seq_id", "ord", "kind", *(F.col(c).cast("double").alias(c) for c in "lr"))


def regions(fx):
    return G.flank_filter(G.trim_regions(G.all_regions(fx("fx_regions"))))


def positions(fx):
    return G.region_positions(regions(fx))


POS = f"{ALL}, posn as (select seq_id, kind, unnest(range(l, r + 1)) as pos from flank where l is not null and r is not null)"


@query("region_positions", "select seq_id, kind, pos from posn", POS)
def _(fx):
    return positions(fx).withColumn("pos", F.col("pos").cast("long"))


@query("var_con_coverage", f"select seq_id as ref_id, round(avg(d) filter (where kind = 'v'), 6) as var, round(avg(d) filter (where kind = 'c'), 6) as con, {pct('avg(d) filter (where kind = $v$)', 'avg(d) filter (where kind = $c$) * 100')} as ratio from (select *, (seq_id * 13 + pos * 7) % 60 as d from posn) group by 1".replace("$v$", "'v'").replace("$c$", "'c'"), POS)
def _(fx):
    p = G.region_spans(regions(fx)).withColumnRenamed("seq_id", "ref_id")
    # a depth for each position of any region, spread out where its join finds it: the positions themselves are not shuffled
    held = D.cut_spans(D.merged_spans(p.withColumnRenamed("ref_id", "contig")).select(F.col("contig").alias("ref_id"), "l", "r"), "l", "r").repartition("ref_id", "bin")
    at = held.select("ref_id", "bin", F.explode(F.sequence("l", "r")).alias("pos"))
    depth = at.select("ref_id", "bin", F.col("pos").alias("start"), F.col("pos").alias("end"), ((F.col("ref_id") * 13 + F.col("pos") * 7) % 60).alias("depth"))
    return D.var_con_coverage(depth, p).withColumns({"var": F.round("var", 6), "con": F.round("con", 6)})


# ---------------------------------------------------------------- from alignments to copy numbers

TRIMMED = "select ref_id, floor((sum(depth) filter (where not dropped) * 200 + count(*) filter (where not dropped)) / (2 * count(*) filter (where not dropped))) / 100 as mean_depth from (select *, coalesce((depth <= low_cut and lows <= k) or (depth >= high_cut and highs <= k), false) as dropped from runs) group by ref_id"
CN = f"""posr as (select 'M' || seq_id as ref_id, kind, pos from posn),
all_mean as ({TRIMMED}), all_ratio as (select ref_id, {pct('avg(depth) filter (where kind = $v$)', 'avg(depth) filter (where kind = $c$) * 100')} as ratio from dep join posr using (ref_id, pos) group by 1),
pairs_of as (select distinct marker, genome % 20 as genome from (select marker, cast(substr(genome, 2) as int) as genome from fx_links where n >= 30)),
scale as (select genome, sum(cov * n) / sum(n) as genome_depth from prof group by genome),
norm as (select p.marker, p.genome, m.mean_depth / nullif(a.cov / nullif(b.cov, 0), 0) as depth_all, r.ratio as ratio_all
  from pairs_of p join all_mean m on m.ref_id = p.marker join all_ratio r on r.ref_id = p.marker left join prof a on a.genome = p.genome and a.gc = 40 + cast(substr(marker, 2) as int) % 3 * 5 left join prof b on b.genome = p.genome and b.gc = 45)""".replace("$v$", "'v'").replace("$c$", "'c'")


@query("copy_numbers", f"""select marker, genome, round(best_depth, 6) as best_depth, round(genome_depth, 6) as genome_depth, round(best_depth / genome_depth, 6) as copies from (
  select n.marker, n.genome, s.genome_depth, case when ratio_all between 0.85 and 1.15 then depth_all when ratio_all < 0.85 then depth_all * ratio_all else depth_all / ratio_all end as best_depth
  from norm n join scale s using (genome) where ratio_all <> 0)""", f"{TRIM}, {POS}, {BASES}, {CN}")
def _(fx):
    """Linked alignments are all alignments here, so that the two ratios agree; tests hold the choice between them."""
    a = fx("fx_aln").filter("side = 'marker'")
    n = F.substring("marker", 2, 9).cast("int")
    links = fx("fx_links").filter("n >= 30").select("marker", (F.substring("genome", 2, 9).cast("int") % 20).alias("genome")).distinct()
    markers = fx("fx_markers").select("marker", (40 + n % 3 * 5 + 0.25).alias("gc_marker"))
    spans = G.region_spans(regions(fx)).select(F.concat(F.lit("M"), F.col("seq_id").cast("string")).alias("ref_id"), "kind", "l", "r")
    out = D.copy_numbers(a, a, cut(a.select("ref_id", "ref_len").distinct(), "refs"), spans, markers, cut(profile(fx), "profile").withColumn("gc_genome", F.lit(44.75)), links)
    return out.withColumns({c: F.round(c, 6) for c in ("best_depth", "genome_depth", "copies")})
