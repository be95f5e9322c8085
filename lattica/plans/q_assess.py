"""Queries that hold links against known clusters and taxonomies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess as S
from .registry import query
from .sqltext import pct

NUM = "cast(substr({}, 2) as int)"
TRUTH = f"""mc as (select marker, {NUM.format('marker')} % 12 as cluster from fx_markers where {NUM.format('marker')} % 7 <> 0),
gc as (select distinct genome, {NUM.format('genome')} % 12 as cluster from fx_contigs where {NUM.format('genome')} % 5 <> 0),
judged as (select l.*, case when m.cluster = g.cluster then 'Correct' when m.cluster is not null and g.cluster is not null then 'Wrong' else 'Unknown' end as verdict, case when l.n >= 9 then 'Rd1' else 'Rd2' end as round
  from fx_links l left join mc m using (marker) left join gc g using (genome) where l.n >= 3),
per as (select genome, case when bool_or(verdict = 'Correct') and bool_or(verdict = 'Wrong') then 'Ambiguous' when bool_or(verdict = 'Correct') then 'Correct' when bool_or(verdict = 'Wrong') then 'Wrong' else 'Unknown' end as v from judged group by 1)"""


def truth(fx):
    n = lambda c: F.substring(c, 2, 9).cast("int")
    m = fx("fx_markers").filter(n("marker") % 7 != 0).select("marker", (n("marker") % 12).alias("cluster"))
    g = fx("fx_contigs").filter(n("genome") % 5 != 0).select("genome", (n("genome") % 12).alias("cluster")).distinct()
    return m, g


def judged(fx):
    links = fx("fx_links").filter("n >= 3").withColumn("round", F.when(F.col("n") >= 9, "Rd1").otherwise("Rd2"))
    return S.assess_links(links, *truth(fx))


@query("assess_links", "select marker, genome, n, verdict from judged", TRUTH)
def _(fx):
    return judged(fx).select("marker", "genome", "n", "verdict")


@query("link_accuracy", f"select count(distinct marker) as markers, cast(coalesce(sum(n) filter (where verdict = 'Correct'), 0) as bigint) as right, cast(coalesce(sum(n) filter (where verdict = 'Wrong'), 0) as bigint) as wrong, {pct('coalesce(sum(n) filter (where verdict = $$Correct$$), 0)', 'coalesce(sum(n) filter (where verdict <> $$Unknown$$), 0)')} as accuracy from judged".replace("$$", "'").replace("as right", 'as "right"'), TRUTH)
def _(fx):
    return S.link_accuracy(judged(fx))


def _c(v: str) -> str:
    return f"count(*) filter (where v = '{v}')"


@query("genome_accuracy", f"select count(*) as genomes, {_c('Correct')} as \"right\", {_c('Wrong')} as wrong, {_c('Ambiguous')} as ambiguous, {_c('Unknown')} as unknown, {pct(_c('Correct'), 'count(*) filter (where v <> ' + chr(39) + 'Unknown' + chr(39) + ')')} as accuracy from per", TRUTH)
def _(fx):
    return S.genome_accuracy(judged(fx))


ROLL = f"""{TRUTH}, two as (select genome, verdict, unnest([round, 'total']) as round from judged),
ln as (select round, count(*) filter (where verdict = 'Correct') as links_correct, count(*) filter (where verdict = 'Wrong') as links_wrong, count(*) filter (where verdict = 'Unknown') as links_unknown from two group by 1),
gv as (select round, genome, case when bool_or(verdict = 'Correct') and bool_or(verdict = 'Wrong') then 'Ambiguous' when bool_or(verdict = 'Correct') then 'Correct' when bool_or(verdict = 'Wrong') then 'Wrong' else 'Unknown' end as v from two group by 1, 2)"""


@query("assess_rollup", f"select ln.*, g.genomes, g.genomes_correct, g.genomes_wrong, g.genomes_ambiguous, {pct('g.genomes', '(select count(distinct genome) from fx_contigs)')} as recovery from ln join (select round, count(*) as genomes, {_c('Correct')} as genomes_correct, {_c('Wrong')} as genomes_wrong, {_c('Ambiguous')} as genomes_ambiguous from gv group by 1) g using (round)", ROLL)
def _(fx):
    return S.assess_rollup(judged(fx), fx("fx_contigs").select("genome").distinct().count())


HITS = "hits as (select 'G' || (l_orderkey % 25) as genome, 'R' || (l_partkey % 9) as ref, l_partkey % 9 % 4 as cluster, 98 + (l_suppkey % 30) * 0.1 as iden, cast(1000 + l_extendedprice as int) as aln_len from lineitem)"


def _hits(fx):
    return fx.table("lineitem").select(
        F.concat(F.lit("G"), (F.col("l_orderkey") % 25).cast("string")).alias("genome"), F.concat(F.lit("R"), (F.col("l_partkey") % 9).cast("string")).alias("ref"), (F.col("l_partkey") % 9 % 4).alias("cluster"),
        (98 + (F.col("l_suppkey") % 30) * 0.1).alias("iden"), (1000 + F.floor("l_extendedprice")).cast("int").alias("aln_len"),
    )


@query("genome_to_cluster", "select distinct genome, cluster from (select genome, ref, cluster from hits where iden >= 99.5 and aln_len > 1500 group by all having sum(aln_len) >= 524288)", HITS.replace("cast(1000 + l_extendedprice as int)", "cast(1000 + floor(l_extendedprice) as int)"))
def _(fx):
    return S.genome_to_cluster(_hits(fx))


@query("marker_to_cluster", "select distinct query as marker, cast(substr(subject, 2) as int) % 4 as cluster from fx_hits where iden >= 99.5 and aln_len > 500 and aln_len * 100 >= qlen * 70")
def _(fx):
    h = fx("fx_hits").select(F.col("query").alias("marker"), (F.substring("subject", 2, 9).cast("int") % 4).alias("cluster"), "iden", "aln_len", "qlen")
    return S.marker_to_cluster(h)


TAXA = "tx as (select c_custkey, [n_regionkey::varchar, case when c_custkey % 6 = 0 then '' else n_nationkey::varchar end, (c_custkey % 3)::varchar] as a, [n_regionkey::varchar, case when c_custkey % 4 = 0 then 'x' else n_nationkey::varchar end, (c_custkey % 3 + case when c_custkey % 10 = 0 then 1 else 0 end)::varchar] as b from customer join nation on c_nationkey = n_nationkey)"


@query("taxon_rank_accuracy", """select r - 1 as rank, count(*) filter (where v = 'right') as "right", count(*) filter (where v = 'wrong') as wrong, count(*) filter (where v = 'unknown') as unknown from (
  select r, case when exists (select 1) and len(list_filter(range(1, r), lambda j: a[j] <> '' and a[j] <> b[j])) > 0 then 'wrong' when a[r] = '' then 'unknown' when a[r] <> b[r] then 'wrong' else 'right' end as v from (select *, unnest([1, 2, 3]) as r from tx)) group by r""", TAXA)
def _(fx):
    t = fx.table("customer").join(F.broadcast(fx.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    a = F.concat_ws(";", s(F.col("n_regionkey")), F.when(k % 6 == 0, "").otherwise(s(F.col("n_nationkey"))), s(k % 3))
    b = F.concat_ws(";", s(F.col("n_regionkey")), F.when(k % 4 == 0, "x").otherwise(s(F.col("n_nationkey"))), s(k % 3 + (k % 10 == 0).cast("int")))
    return S.taxon_rank_accuracy(t.select(k, a.alias("a"), b.alias("b")), "a", "b")


@query("genome_report", f"""select c.genome, contigs, bases, coalesce(depth, 0) as depth, coalesce(own, 0) as own, coalesce(own_len, 0) as own_len, coalesce(completeness, 0) as completeness,
  coalesce(linked, 0) as linked, coalesce(linked_lens, '') as linked_lens, coalesce(best, 'NA') as best, coalesce(taxon, 'unknown') as taxon
from (select genome, count(*) as contigs, cast(sum(ref_len) as bigint) as bases, {NUM.format('genome')} as k from fx_contigs group by 1) c
left join (select genome, count(*) as own, max(r - l + 1) as own_len from fx_features join fx_contigs using (contig) where feature = '16S_rRNA' and l > 250 group by 1) f using (genome)
left join (select genome, count(*) as linked, string_agg(ref_len, ';' order by ref_len desc) as linked_lens, max_by(marker, (n, marker)) as best from fx_links left join fx_markers using (marker) where n >= 60 group by 1) k using (genome)
left join (select k, case when k % 3 <> 0 then k * 0.5 end as depth, case when k % 4 <> 0 then 100.0 - k % 30 end as completeness, case when k % 5 <> 0 then 'd__' || (k % 7) end as taxon from (select distinct {NUM.format('genome')} as k from fx_contigs)) t on t.k = c.k""")
def _(fx):
    n = F.substring("genome", 2, 9).cast("int")
    g = fx("fx_contigs").select("genome").distinct()
    return S.genome_report(
        fx("fx_contigs"), fx("fx_links").filter("n >= 60"), fx("fx_features").filter("feature = '16S_rRNA' and l > 250"), fx("fx_markers"), g.filter(n % 3 != 0).withColumn("depth", n * 0.5),
        g.filter(n % 4 != 0).withColumn("completeness", (100 - n % 30).cast("double")), g.filter(n % 5 != 0).withColumn("taxon", F.concat(F.lit("d__"), (n % 7).cast("string"))),
    )


@query("genomes_with_marker", "select distinct genome from gc where cluster in (select cluster from mc where marker in (select marker from fx_links where n >= 20))", TRUTH)
def _(fx):
    m, g = truth(fx)
    return S.genomes_with_marker(g, m.join(fx("fx_links").filter("n >= 20"), "marker", "left_semi"))


@query("expected_copy_number", "select genome, avg(p_size) as copies from gc join (select p_partkey % 12 as cluster, p_size from part) r using (cluster) group by 1", TRUTH)
def _(fx):
    refs = fx.table("part").select((F.col("p_partkey") % 12).cast("int").alias("cluster"), F.col("p_size").alias("copies"))
    return S.expected_copy_number(truth(fx)[1], refs)


@query("src_assess_tables", """select genome, cast(k % 12 as varchar) as cluster, 'd__' || (k % 7) || ';p__x' as taxon, 'R' || (k % 9) as closest, k % 50 * 2.0 as completeness, k * 0.5 as depth, 1200 + k as marker_len, 2 as genes, 'd__' || (k % 3) as marker_taxon, 97.5 as iden
from (select distinct genome, cast(substr(genome, 2) as int) as k from fx_contigs)""")
def _(fx):
    from ..sources import readers as R

    n, s = F.substring("genome", 2, 9).cast("int"), lambda c: c.cast("string")
    t = fx("fx_contigs").select("genome").distinct().withColumns({
        "file": F.concat("genome", F.lit(".fna")), "cluster": n % 12, "taxon": F.concat(F.lit("d__"), s(n % 7), F.lit(";p__x")), "x": F.lit("x"), "closest": F.concat(F.lit("R"), s(n % 9)),
        "completeness": n % 50 * 2.0, "depth": n * 0.5, "len": 1200 + n, "genes": F.concat("genome", F.lit("_1,"), "genome", F.lit("_2")), "noted": F.concat(F.lit("d__"), s(n % 3), F.lit(" [note]")), "iden": F.lit(97.5),
    })
    put = lambda name, sep, cols, header=None: R.stored(t, lambda d, p: R.write_lines(d, p, sep, cols, header), name)
    spark = fx.spark
    out = R.read_genome_clusters(spark, put("clusters", ",", ["file", "cluster"], "genome,secondary_cluster"))
    out = out.join(R.read_genome_taxonomy(spark, put("taxa", "\t", ["genome", "taxon", *["x"] * 5, "closest"], "user_genome\tclassification")), "genome")
    out = out.join(R.read_completeness(spark, put("quality", ",", ["genome", "completeness"])), "genome").join(R.read_genome_depth(spark, put("depth", "\t", ["genome", "len", "depth"])), "genome")
    out = out.join(R.read_genome_markers(spark, put("markers", "\t", ["genome", "x", "len"], "Genome\t16S\tLength(bp)")), "genome")
    genes = R.read_gene_to_genome(spark, put("genes", "\t", ["genome", "genes"])).groupBy("genome").agg(F.countDistinct("gene").alias("genes"))
    taxa = R.read_marker_taxonomy(spark, put("best", "\t", ["genome", "x", "iden", "len", "noted"])).select(F.col("marker").alias("genome"), F.col("taxon").alias("marker_taxon"), "iden")
    return out.join(genes, "genome").join(taxa, "genome")
