"""Queries of read pairs, links, identities and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import links as L
from ..operators import pairs as P
from ..operators import rounds as W
from ..operators.groups import cut
from .registry import query
from .sqltext import ALN, BRIDGES, COLS, JOINED, LINKS, PAIRS, ROUND2, SHORT, STATS, TO_CONTIG, TO_MARKER, bridge_cols

PAIR_COLS = ["side", "read_base", "pair_class", "ref_id", "mate", "pos", "cigar", "ref_len"]


def sides(fx):
    a = fx("fx_aln")
    return P.qualify_pairs(a.filter("side = 'marker'")), P.qualify_pairs(a.filter("side = 'contig'"), use_ref_min=False)


def rd1(fx):
    m, c = sides(fx)
    return L.link_reads_rd1(m, c, fx("fx_contigs")), m, c


def hits(fx):
    """The alignments behind links of the first round.  Links are written once, with the alignments of both sides."""
    return L.link_sides(cut(L.link_reads_rd1(*sides(fx), fx("fx_contigs"), hits=True), "links"))


def bridged(fx, name):
    """Both sides of the links of bridges and of markers or contigs."""
    m, c = sides(fx)
    return W.link_reads_mini(P.qualify_pairs(fx("fx_minis"), use_ref_min=False), m if name == "marker" else c, name, opposite_mate=name == "marker")


@query("ref_min_mismatch", "select read_base, mate, coalesce(min(bad) filter (where aligned >= 45), min(bad)) as min_mismatch from aln where side = 'marker' group by all", ALN)
def _(fx):
    return P.ref_min_mismatch(fx("fx_aln").filter("side = 'marker'"))


@query("multi_hit_refs", "select distinct read_base, ref_id from (select read_base, mate, ref_id from fx_aln group by all having count(distinct pos) > 1)")
def _(fx):
    return P.multi_hit_refs(fx("fx_aln"))


@query("qualify_pairs", f"select {', '.join(PAIR_COLS)} from pairs", PAIRS)
def _(fx):
    m, c = sides(fx)
    return m.withColumn("side", F.lit("marker")).unionByName(c.withColumn("side", F.lit("contig"))).select(*PAIR_COLS)


@query("intersect_refs", "select side, read_base, ref_id from pairs where pair_class = 'both' group by all", PAIRS)
def _(fx):
    m, c = sides(fx)
    both = m.withColumn("side", F.lit("marker")).unionByName(c.withColumn("side", F.lit("contig")))
    return both.filter("pair_class = 'both'").select("side", "read_base", "ref_id").distinct()


@query("link_reads_rd1", "select read_base, marker, contig, genome from links", LINKS)
def _(fx):
    return rd1(fx)[0]


@query("link_counts", "select marker, contig, count(distinct read_base) as n from links group by all", LINKS)
def _(fx):
    return L.link_counts(rd1(fx)[0])


@query("short_cigar_pct", "select marker, contig, l.short_pct as short_pct_l, r.short_pct as short_pct_r from l join r using (marker, contig)", STATS)
def _(fx):
    a, b = hits(fx)
    return L._both(a, b, ["marker", "contig"]).select("marker", "contig", "short_pct_l", "short_pct_r")


@query("linked_to_end", "select marker, contig, end_num, end_pct from l", STATS)
def _(fx):
    return L.side_stats(hits(fx)[0], ["marker", "contig"]).select("marker", "contig", "end_num", "end_pct")


@query("matched_positions", "select marker, contig, matched, matched_pct from r", STATS)
def _(fx):
    return L.side_stats(hits(fx)[1], ["marker", "contig"]).select("marker", "contig", "matched", "matched_pct")


@query("clip_pct_diff", f"select marker, contig, l.clip_pct as clip_pct_l, r.clip_pct as clip_pct_r, not (l.cigars > 15 and abs(l.clip_pct - r.clip_pct) > 50) as passed from {JOINED}", STATS)
def _(fx):
    a, b = hits(fx)
    return L._both(a, b, ["marker", "contig"]).select("marker", "contig", "clip_pct_l", "clip_pct_r", L.clip_difference_fine().alias("passed"))


ENDS = "(l.end_num > 0 and l.end_pct >= 5)", "(r.end_num >= 1 and r.end_pct >= 20)"


def _long(out):
    return out.withColumns({c: F.col(c).cast("long") for c in out.columns if c.split("_")[0] in ("end", "matched") and "pct" not in c})


def _qc(fx, rule):
    a, b = hits(fx)
    return _long(rule(a, b, ["marker", "contig"]))


@query("link_qc_rd1", f"select {COLS}, {SHORT} and ({ENDS[0]} or l.matched >= 750) and ({ENDS[1]} or r.matched >= 750) as passed from {JOINED} where l.reads >= 3", STATS)
def _(fx):
    return _qc(fx, L.link_qc_rd1)


@query("link_qc_mini_contig", f"select {bridge_cols('cl', 'cr', 'contig')}, {TO_CONTIG} as passed from cl join cr using (mini, other) where cl.reads >= 3", BRIDGES)
def _(fx):
    return _long(L.link_qc_mini_contig(*bridged(fx, "contig"), ["mini", "contig"]))


@query("link_qc_mini_marker", f"select {bridge_cols('ml', 'mr', 'marker')}, {TO_MARKER} as passed from ml join mr using (mini, other) where ml.reads >= 3", BRIDGES)
def _(fx):
    return _long(L.link_qc_mini_marker(*bridged(fx, "marker"), ["mini", "marker"]))


def passed_counts(fx):
    a, b = hits(fx)
    qc = L.link_qc_rd1(a, b, ["marker", "contig"]).filter("passed")
    return qc.select("marker", "contig", F.col("reads_l").alias("n"))


@query("genome_link_counts", f"select marker, genome, cast(sum(l.reads) as bigint) as n from {JOINED} join fx_contigs using (contig) where l.reads >= 3 and {SHORT} and ({ENDS[0]} or l.matched >= 750) and ({ENDS[1]} or r.matched >= 750) group by all", STATS)
def _(fx):
    return L.genome_link_counts(passed_counts(fx), fx("fx_contigs"))


@query("sink_link_tables", f"select marker, genome, cast(sum(l.reads) as bigint) as n, 'Rd1' as round from {JOINED} join fx_contigs using (contig) where l.reads >= 3 and {SHORT} and ({ENDS[0]} or l.matched >= 750) and ({ENDS[1]} or r.matched >= 750) group by all", STATS)
def _(fx):
    from ..sources import readers as R

    links = L.genome_link_counts(passed_counts(fx), fx("fx_contigs")).withColumn("round", F.lit("Rd1"))
    return R.read_links_tsv(fx.spark, R.stored(links, R.write_links_tsv, "links"))


@query("pairwise_identity", """select least(query, subject) as a, greatest(query, subject) as b, max(iden) as iden from
  (select replace(query, 'Q', 'R') as query, subject, iden, aln_len, qlen from fx_hits)
where query <> subject and aln_len >= 500 and aln_len * 100 >= qlen * 50 and aln_len * 100 >= 1300 * 50 group by all""")
def _(fx):
    h = fx("fx_hits").withColumns({"query": F.replace("query", F.lit("Q"), F.lit("R")), "slen": F.lit(1300)})
    return L.pairwise_identity(h)


@query("pairwise_identity_lookup", "select m1.marker as a, m2.marker as b, coalesce(i.iden, 0) as iden from fx_links m1 join fx_links m2 on m1.genome = m2.genome and m1.marker < m2.marker left join fx_ident i on i.a = least(m1.marker, m2.marker) and i.b = greatest(m1.marker, m2.marker) group by all")
def _(fx):
    pairs = fx.sql("select m1.marker as x, m2.marker as y from fx_links m1 join fx_links m2 on m1.genome = m2.genome and m1.marker < m2.marker group by 1, 2")
    return L.with_identity(pairs, "x", "y", fx("fx_ident")).select(F.col("x").alias("a"), F.col("y").alias("b"), "iden")


@query("mean_identity", """select g.genome, g.marker, floor(sum(coalesce(i.iden, 0)) / count(*) * 1000 + 0.5) / 1000 as mean_iden
from fx_links g join fx_links o on o.genome = g.genome and o.marker <> g.marker left join fx_ident i on i.a = least(g.marker, o.marker) and i.b = greatest(g.marker, o.marker) group by all""")
def _(fx):
    return L.mean_identity(fx("fx_ident"), fx("fx_links"), "genome", "marker")


BEST = """best as (select genome, marker from (select *, rank() over (partition by genome order by n desc) as k from (select marker, genome, cast(floor(n / 60.0) * 60 as bigint) as n from fx_links) where n >= 3) where k = 1),
bad as (select x.genome from best x join best y on x.genome = y.genome and x.marker < y.marker left join fx_ident i on i.a = least(x.marker, y.marker) and i.b = greatest(x.marker, y.marker) group by 1 having min(coalesce(i.iden, 0)) <= 99),
tied as (select distinct marker from best where genome in (select genome from bad))"""


@query("ambiguous_best", """select 'genome' as kind, genome as id from bad union all select 'best', marker from tied
union all select distinct 'all', id from (select a as m, b as id from fx_ident where iden >= 99 union all select b, a from fx_ident where iden >= 99) where m in (select marker from tied)""", BEST)
def _(fx):
    rounded = fx("fx_links").withColumn("n", (F.floor(F.col("n") / 60) * 60).cast("long"))  # so that counts tie
    return A.ambiguous_best(rounded, fx("fx_ident"))


@query("greedy_assign")
def _(fx):
    left, right = hits(fx)
    by_genome = L.genome_link_counts(L.link_qc_rd1(left, right, ["marker", "contig"]).filter("passed").select("marker", "contig", F.col("reads_l").alias("n")), fx("fx_contigs"))
    return A.greedy_assign(cut(by_genome, "links"), fx("fx_markers"), fx("fx_ident"), W.clip_shares(left, right, fx("fx_contigs")))


@query("link_markers")
def _(fx):
    a = fx("fx_aln")
    return W.link_markers(a.filter("side = 'marker'"), a.filter("side = 'contig'"), fx("fx_minis"), fx("fx_contigs"), fx("fx_markers"), fx("fx_ident"))


@query("round2_links", "select marker, genome, cast(sum(n) as bigint) as n from mini_marker join bridge using (mini) group by all", ROUND2)
def _(fx):
    m, c, x = (cut(d, "pairs") for d in (*sides(fx), P.qualify_pairs(fx("fx_minis"), use_ref_min=False)))
    return W.second_round(m, c, x, fx("fx_contigs"))[2]


@query("greedy_assign_simple")
def _(fx):
    return A.greedy_assign_simple(fx("fx_links"), fx("fx_ident"))


@query("greedy_assign_mini", """select marker, genome, n from (select *, max(n) over (partition by genome) as best from (select *, row_number() over (partition by marker order by n desc, genome) as k from fx_links where n >= 3) where k = 1) where n >= best * 0.8""")
def _(fx):
    return A.greedy_assign_mini(fx("fx_links"), "marker", "genome")


@query("best_hit_per_query", "select query, subject, iden, bitscore, ord from (select *, row_number() over (partition by query order by bitscore desc, ord) as k from fx_hits) where k = 1")
def _(fx):
    return A.best_hit_per_query(fx("fx_hits")).select("query", "subject", "iden", "bitscore", "ord")


@query("marker_domain", "select m.marker, coalesce(case when h.subject in ('R1', 'R2', 'R3') then 'Archaea' when h.subject is not null then 'Bacteria' end, 'Bacteria') as domain from fx_markers m left join (select * from (select *, row_number() over (partition by query order by bitscore desc, ord) as k from fx_hits) where k = 1) h on h.query = replace(m.marker, 'M', 'Q')")
def _(fx):
    taxon = F.when(F.col("subject").isin("R1", "R2", "R3"), "Archaea;x").otherwise("Bacteria;y")
    return W.marker_domain(fx("fx_markers"), fx("fx_hits").select(F.replace("query", F.lit("Q"), F.lit("M")).alias("marker"), taxon.alias("taxon"), "bitscore", "ord"))


@query("first_link_per_item", "select marker, genome, n from (select *, row_number() over (partition by marker order by n desc, genome) as k from fx_links where n >= 3) where k = 1")
def _(fx):
    return A.best_hit_per_query(fx("fx_links").filter("n >= 3"), "marker", "n", "genome").select("marker", "genome", "n")


def _linked(sides, name):
    """Reads of links with their alignments on both sides."""
    left, right = sides
    keys = ["mini", name, "read_base"]
    a = left.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pos", "cigar"))), ",").alias("mini_side"))
    b = right.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pos", "cigar"))), ",").alias("other_side"))
    return a.join(b, keys)


def _linked_sql(name, mate):
    each = lambda x: f"string_agg({x}.pos || ':' || {x}.cigar, ',' order by {x}.pos || ':' || {x}.cigar)"
    return f"select m.ref_id as mini, o.ref_id as {name}, m.read_base, {each('m')} as mini_side, {each('o')} as other_side from pairs m join pairs o on o.read_base = m.read_base and {mate} = m.mate where m.side = 'mini' and o.side = '{name}' group by all"


@query("link_reads_mini_contig", _linked_sql("contig", "o.mate"), BRIDGES)
def _(fx):
    return _linked(bridged(fx, "contig"), "contig")


@query("link_reads_mini_marker", _linked_sql("marker", "3 - o.mate"), BRIDGES)
def _(fx):
    return _linked(bridged(fx, "marker"), "marker")


TO_MINI = "mm as (select marker, 'X' || (n % 17) as mini, n from fx_links), mg as (select 'X' || k as mini, 'G' || (k * 7 % 40) as genome from (select distinct n % 17 as k from fx_links))"


@query("links_with_round2_bridge", "select marker, genome, cast(sum(n) as bigint) as n from mm join mg using (mini) group by all", TO_MINI)
def _(fx):
    mm = fx("fx_links").select("marker", F.concat(F.lit("X"), (F.col("n") % 17).cast("string")).alias("mini"), "n")
    mg = fx("fx_links").select((F.col("n") % 17).alias("k")).distinct().select(F.concat(F.lit("X"), F.col("k").cast("string")).alias("mini"), F.concat(F.lit("G"), (F.col("k") * 7 % 40).cast("string")).alias("genome"))
    return W.links_with_bridge(mm, mg)


@query("union_rounds", "select marker, genome, n, 'Rd1' as round from fx_links where n >= 60 union all select marker, genome, n, 'Rd2' from fx_links where n between 3 and 59")
def _(fx):
    k = fx("fx_links")
    return W.union_rounds(Rd1=k.filter("n >= 60"), Rd2=k.filter("n between 3 and 59"))


@query("union_flanking_reads", "select read_base from fx_aln where side = 'marker' and pos <= 50 union select read_base from fx_aln where side = 'contig' and pos <= 50")
def _(fx):
    a = fx("fx_aln")
    return W.union_flanking_reads(a.filter("side = 'marker'"), a.filter("side = 'contig'"))


@query("unrecovered", "select marker from fx_markers where marker not in (select marker from fx_links where n >= 9)")
def _(fx):
    return W.unrecovered(fx("fx_markers"), fx("fx_links").filter("n >= 9"), "marker")


@query("gained_genomes", "select distinct genome from fx_links where n >= 9 and genome not in (select genome from fx_contigs join fx_features using (contig) where feature = '16S_rRNA' and r - l + 1 >= 69)")
def _(fx):
    return W.gained_genomes(fx("fx_links").filter("n >= 9"), fx("fx_contigs"), fx("fx_features").filter("feature = '16S_rRNA'"), 69)


@query("edge_totals", "select 'marker-contig' as level, marker as a, contig as b, count(distinct read_base) as n from links group by all union all select 'contig-genome', contig, genome, count(distinct read_base) from links group by all", LINKS)
def _(fx):
    return W.edge_totals(cut(rd1(fx)[0], "links"))


@query("links_by_contig", """select marker, genome, contig, cast(sum(rd1) as bigint) as rd1, cast(sum(rd2) as bigint) as rd2 from (
  select marker, contig, l.reads as rd1, 0 as rd2 from l join r using (marker, contig) where l.reads >= 9 union all select marker, contig, 0, l.reads from l join r using (marker, contig) where l.reads between 3 and 12)
join fx_contigs using (contig) join (select distinct marker, genome from fx_links where n >= 30) using (marker, genome) group by all""", STATS)
def _(fx):
    a, b = hits(fx)
    n = cut(L.link_qc_rd1(a, b, ["marker", "contig"]).select("marker", "contig", F.col("reads_l").alias("n")), "links")
    return W.links_by_contig(fx("fx_links").filter("n >= 30"), fx("fx_contigs"), rd1=n.filter("n >= 9"), rd2=n.filter("n between 3 and 12"))


@query("sort_links", "select row_number() over (order by n desc, marker, genome) as place, marker, genome, n from fx_links")
def _(fx):
    from ..sources.readers import number_rows

    k = fx("fx_links").withColumn("down", -F.col("n"))
    return number_rows(k, ["down", "marker", "genome"], "place").select("place", "marker", "genome", "n")


@query("sort_alignments", "select ref_id, pos, read_base, mate from fx_aln")
def _(fx):
    from ..sources.readers import sort_alignments

    return sort_alignments(fx("fx_aln"), by_name=False).select("ref_id", "pos", "read_base", "mate")


@query("paired_clip_combine", "select coalesce(a.marker, b.marker) as marker, coalesce(a.genome, b.genome) as genome, coalesce(a.n, 0) as paired, coalesce(b.n, 0) as clipped from (select * from fx_links where n % 3 <> 0) a full join (select * from fx_links where n % 2 = 0) b on a.marker = b.marker and a.genome = b.genome where coalesce(a.n, 0) > 0")
def _(fx):
    k = fx("fx_links")
    return W.paired_clip_combine(k.filter("n % 3 <> 0"), k.filter("n % 2 = 0"))


@query("gap_fill_stats", """select marker, genome, cast(sum(m.n) as bigint) as marker_n, cast(sum(c.n) as bigint) as contig_n from m join c using (mini) join peaks using (mini)
where least(mt, ct) * 1.0 / greatest(mt, ct) >= 0.3 and m.n >= mt * 0.5 and c.n >= ct * 0.5 and m.n >= m.own * 0.5 and c.n >= c.own * 0.5 group by all""",
       """mini_m as (select 'X' || (l_partkey % 25) as mini, 'M' || (l_suppkey % 20) as marker, count(*) as n from lineitem group by all having count(*) >= 3),
mini_c as (select 'X' || (l_partkey % 25) as mini, 'G' || (l_orderkey % 15) as genome, count(*) as n from lineitem group by all having count(*) >= 3),
m as (select *, max(n) over (partition by marker) as own from mini_m), c as (select *, max(n) over (partition by genome) as own from mini_c),
peaks as (select mini, max(m.n) as mt, max(c.n) as ct from m join c using (mini) group by 1)""")
def _(fx):
    li = fx.table("lineitem").withColumn("mini", F.concat(F.lit("X"), (F.col("l_partkey") % 25).cast("string")))
    counted = lambda name, prefix, col, mod: li.groupBy("mini", F.concat(F.lit(prefix), (F.col(col) % mod).cast("string")).alias(name)).agg(F.count("*").alias("n"))
    return W.gap_fill_stats(counted("marker", "M", "l_suppkey", 20), counted("genome", "G", "l_orderkey", 15))


@query("sink_qc_tables", f"select {COLS}, {SHORT} and ({ENDS[0]} or l.matched >= 750) and ({ENDS[1]} or r.matched >= 750) as passed from {JOINED} where l.reads >= 3", STATS)
def _(fx):
    from ..sources import readers as R

    out = _qc(fx, L.link_qc_rd1)
    path = R.stored(out, lambda d, p: d.write.csv(p, sep="\t", header=True), "qc")
    return fx.spark.read.csv(path, sep="\t", header=True, schema=out.schema)
