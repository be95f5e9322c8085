"""Queries of clusters, pivots, statistics and k-mer joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import tables as T
from ..operators.groups import cut
from .registry import query
from .sqltext import pct


@query("cluster_members", "select source, string_agg(distinct cast(doc_id % 97 as string), ',' order by cast(doc_id % 97 as string)) as members from documents group by source")
def _(fx):
    return T.cluster_members(fx.table("documents").withColumn("m", F.col("doc_id") % 97), "source", "m")


@query("cluster_longest", "select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k = 1")
def _(fx):
    return T.cluster_longest(fx.table("documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("exact_dereplicate", "select sha256(text) as digest, min(doc_id) as representative, count(*) as n from documents group by 1")
def _(fx):
    return T.exact_dereplicate(fx.table("documents"), "text", "doc_id")


@query("pivot_counts", "select user_id % 50 as u, " + ", ".join(f"count(*) filter (where event_id % 4 = {i}) as c{i}" for i in range(4)) + " from events group by 1")
def _(fx):
    e = fx.table("events").select((F.col("user_id") % 50).alias("u"), (F.col("event_id") % 4).alias("k"))
    return T.pivot_counts(e, "u", "k", [0, 1, 2, 3]).select("u", *(F.col(str(i)).alias(f"c{i}") for i in range(4)))


@query("relative_abundance", "select id, " + ", ".join(f"coalesce(max(case when s = {i} then n * 1.0 / t end), 0.0) as s{i}" for i in range(3)) + " from (select *, sum(n) over (partition by s) as t from (select id, s, count(*) as n from (select unnest(string_split((user_id % 11) || ':' || (event_id % 7), ':')) as id, user_id % 3 as s from events) group by all)) group by id")
def _(fx):
    e = fx.table("events").select(F.concat_ws(":", (F.col("user_id") % 11).cast("string"), (F.col("event_id") % 7).cast("string")).alias("ids"), (F.col("user_id") % 3).alias("s"))
    return T.relative_abundance(e, "ids", "s", [0, 1, 2]).select("id", *(F.col(str(i)).alias(f"s{i}") for i in range(3)))


@query("subset_nonzero_rows", "select u, a, b from (select user_id as u, count(*) filter (where event_id % 9 = 0) as a, count(*) filter (where event_id % 13 = 0) as b from events group by 1) where a > 0 or b > 0")
def _(fx):
    e = fx.table("events").groupBy(F.col("user_id").alias("u")).agg(F.count_if(F.col("event_id") % 9 == 0).alias("a"), F.count_if(F.col("event_id") % 13 == 0).alias("b"))
    return T.subset_nonzero_rows(e, "u", ["a", "b"])


@query("linear_fit", "select round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 4) as intercept, round(regr_r2(p_retailprice, p_size), 8) as r2 from part")
def _(fx):
    return T.linear_fit(fx.table("part"), "p_retailprice", "p_size").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


RANKED = """x as (select l_partkey as k, cast(sum(l_quantity) as double) as x from lineitem where l_orderkey % 3 <> 0 group by 1), y as (select l_partkey as k, cast(sum(l_quantity) as double) as y from lineitem where l_orderkey % 3 <> 1 group by 1),
b as (select coalesce(x.k, y.k) as k, coalesce(x, 0) as x, coalesce(y, 0) as y from x full join y on x.k = y.k),
r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from b)"""


@query("spearman", "select round(corr(rx, ry), 8) as rho, count(*) as n from r", RANKED)
def _(fx):
    li = fx.table("lineitem")
    one = lambda keep: li.filter(keep).groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias("v"))
    return T.spearman(one(F.col("l_orderkey") % 3 != 0), one(F.col("l_orderkey") % 3 != 1), "l_partkey", "v").withColumn("rho", F.round("rho", 8))


TIED = """v as (select cast(floor(l_quantity) as int) as v, case when l_linenumber <= 2 then 1 else 0 end as s from lineitem),
c as (select v, cast(count(*) filter (where s = 1) as double) as x, cast(count(*) as double) as t from v group by 1),
r as (select *, sum(t) over (order by v) - t + (t + 1) / 2 as r from c),
g as (select sum(x) as n1, sum(t) - sum(x) as n2, sum(t) as n, sum(x * r) as total, sum(t * t * t - t) as ties from r),
m as (select *, total - n1 * (n1 + 1) / 2 as u from g),
w as (select *, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) as z from m),
e as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as k from w)"""


@query("mann_whitney_u", "select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, u, round(z, 6) as z, round(k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-z * z / 2), 6) as p from e", TIED)
def _(fx):
    li = fx.table("lineitem").withColumn("v", F.floor("l_quantity").cast("int"))
    return T.mann_whitney_u(li.filter("l_linenumber <= 2"), li.filter("l_linenumber > 2"), "v").withColumns({"z": F.round("z", 6), "p": F.round("p", 6)})


@query("histogram_filtered", f"select floor(iden / 0.5) * 0.5 as bin, count(*) as n, {pct('sum(count(*) filter (where iden >= 98)) over ()', 'sum(count(*)) over ()')} as high_pct from fx_hits where aln_len >= 500 group by 1")
def _(fx):
    return T.histogram_filtered(fx("fx_hits"), "iden", "aln_len", 500, 0.5, 98)


@query("insert_size_share", f"select cutoff, cast(count(*) filter (where v >= cutoff) as bigint) as n, {pct('count(*) filter (where v >= cutoff)', 'count(*)')} as share from (select l_quantity * 5 as v from lineitem), (values (50), (100), (150), (200)) c(cutoff) group by cutoff")
def _(fx):
    return T.insert_size_share(fx.table("lineitem"), F.col("l_quantity") * 5, [50, 100, 150, 200])


@query("feature_index", "select genome || '_16S_' || row_number() over (partition by genome order by contig, l, r) as name, contig, l, r, r - l + 1 as len from fx_features join fx_contigs using (contig) where feature = '16S_rRNA'")
def _(fx):
    f = fx("fx_features").filter("feature = '16S_rRNA'").join(fx("fx_contigs").select("contig", "genome"), "contig")
    return T.feature_index(f, "genome")


@query("feature_count_per_genome", "select genome, count(f.l) as n from fx_contigs c left join (select * from fx_features where feature = '16S_rRNA' and l > 200) f using (contig) group by 1")
def _(fx):
    return T.feature_count_per_genome(fx("fx_contigs"), fx("fx_features").filter("feature = '16S_rRNA' and l > 200"))


@query("one_per_taxon", "select n_regionkey, n_nationkey, n_name from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) where k = 1")
def _(fx):
    return T.one_per_taxon(fx.table("nation"), "n_regionkey", "n_nationkey").select("n_regionkey", "n_nationkey", "n_name")


@query("well_assigned_pct", f"select a.ref_id as a, b.ref_id as b, count(*) as n, {pct('count(*)', 'max(o.n)')} as share from h a join h b using (read_base) join (select ref_id, count(*) as n from h group by 1) o on o.ref_id = a.ref_id group by a.ref_id, b.ref_id", "h as (select distinct ref_id, read_base from fx_aln where side = 'marker')")
def _(fx):
    return T.well_assigned(fx("fx_aln").filter("side = 'marker'"))


# a k-mer is the lesser of itself and its reverse complement
KMERS = "km as (select distinct seq_id, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer from (select seq_id, substr(seq, i, 8) as kmer from (select *, unnest(range(1, length(seq) - 6)) as i from fx_strands)))"
ONE_KMERS = KMERS.replace("from fx_strands", "from (select min(seq_id) as seq_id, seq from fx_strands group by seq)")


@query("kmer_similarity_join", "select a.seq_id as a, b.seq_id as b, count(*) * 1.0 / (max(na.n) + max(nb.n) - count(*)) as sim from km a join km b on a.kmer = b.kmer and a.seq_id < b.seq_id join (select seq_id, count(*) as n from km group by 1) na on na.seq_id = a.seq_id join (select seq_id, count(*) as n from km group by 1) nb on nb.seq_id = b.seq_id group by 1, 2 having count(*) * 1.0 / (max(na.n) + max(nb.n) - count(*)) >= 0.1", ONE_KMERS)
def _(fx):
    return T.kmer_similarity_join(fx("fx_strands"), "seq_id", "seq", 8, 0.1)


@query("recruit_reads", "select seq_id, count(*) as n from km where kmer in (select kmer from km where seq_id % 10 = 0) group by 1 having count(*) >= 3", KMERS)
def _(fx):
    s = fx("fx_strands")
    return T.recruit_reads(s, s.filter("seq_id % 10 = 0"), "seq_id", "seq", 8, 3)


@query("similarity_cluster")
def _(fx):
    s = fx("fx_strands")
    of = cut(T.sequence_classes(s, "seq_id", "seq"), "classes")  # read twice
    sizes = s.select(F.col("seq_id").alias("id"), F.length("seq").cast("long").alias("size"))
    found = A.similarity_cluster(sizes.join(of.filter("seq_id = representative").select(F.col("seq_id").alias("id")), "id", "left_semi"), T.kmer_similarity_join(s, "seq_id", "seq", 8, 0.1), 0.1)
    return of.join(found, F.col("representative").cast("string") == F.col("id")).select(F.col("seq_id").cast("string").alias("id"), "centroid")


@query("spurious_share", f"select l_linenumber as rate, {pct('count(*) filter (where not good)', 'count(*)')} as share, count(*) as n from (select l_linenumber, l_orderkey, max(case when l_discount >= 0.05 and l_tax >= 0.02 then 1 else 0 end) = 1 as good from lineitem group by 1, 2) group by 1")
def _(fx):
    out = T.spurious_share(fx.table("lineitem"), "l_linenumber", "l_orderkey", (F.col("l_discount") >= 0.05) & (F.col("l_tax") >= 0.02))
    return out.withColumnRenamed("l_linenumber", "rate")


# columns 38 to 62 are filled by one row in 25; no window of a grid of 25 lies in them
@query("msa_sparse_column_filter", """select seq_id from rws where seq_id not in (select c.seq_id from cells c join (select w from cells where full_c group by w having floor((count(*) * 200000 + (select count(*) from rws)) / (2 * (select count(*) from rws))) < 10000) s using (w) where c.full_c)""",
       "rws as (select seq_id, substr(seq, 1, 37) || case when seq_id % 25 = 0 then 'ACGTACGTACGTACGTACGTACGTA' else repeat('-', 25) end || substr(seq, 38, 13) as seq from fx_seq), cells as (select seq_id, w, regexp_matches(substr(seq, w, 25), '[^-]') as full_c from (select *, unnest(range(1, length(seq) - 23)) as w from rws))")
def _(fx):
    middle = F.when(F.col("seq_id") % 25 == 0, F.lit("ACGTACGTACGTACGTACGTACGTA")).otherwise(F.repeat(F.lit("-"), F.lit(25)))
    rows = fx("fx_seq").select("seq_id", F.concat(F.substring("seq", 1, 37), middle, F.substring("seq", 38, 13)).alias("seq"))
    return T.msa_sparse_column_filter(rows, "seq_id", "seq", 25, 0.1).select("seq_id")
