"""Queries of column expressions, filters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequence as S
from ..operators import sequences as Q
from ..operators import pairs as P
from ..sources import readers as R
from .registry import query
from .sqltext import ALN, both_clipped, mid_clip, mismatch, op_len, pct

KEY = "read_base, mate, side, ref_id, pos, cigar"
KEYS = KEY.split(", ")


@query("read_base_mate", "select l_orderkey || '.' || l_linenumber as id, cast(l_orderkey as string) as base, cast(l_linenumber as string) as mate from lineitem")
def _(fx):
    ids = fx.table("lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"))
    return ids.select("id", S.read_base(F.col("id")).alias("base"), S.read_mate(F.col("id")).alias("mate"))


@query("prefix_contig_ids", "select contig, genome || '___C___' || contig as full_id from fx_contigs")
def _(fx):
    return fx("fx_contigs").select("contig", F.concat_ws("___C___", "genome", "contig").alias("full_id"))


@query("cigar_ops", rf"select {KEY}, list_aggregate(list_transform(regexp_extract_all(cigar, '\d+[A-Za-z=]'), lambda v: v), 'string_agg', ',') as ops, len(regexp_extract_all(cigar, '\d+[A-Za-z=]')) as n_ops from fx_aln")
def _(fx):
    ops = C.cigar_ops(F.col("cigar"))
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ",")
    return fx("fx_aln").select(*KEYS, text.alias("ops"), F.size(ops).cast("long").alias("n_ops"))


def _stats_sql(ops: str) -> str:
    a, s = op_len("cigar", ops), op_len("cigar", "Ss")
    return f"select {KEY}, {a} as aln_len, {pct(a, f'{a} + {s}')} as aln_pct, {s} as clip_len, {pct(s, f'{a} + {s}')} as clip_pct, {mismatch('cigar', ops)} as mismatch_pct from fx_aln"


@query("cigar_stats", _stats_sql("MIXmix="))
def _(fx):
    return fx("fx_aln").select(*KEYS, C.cigar_stats(F.col("cigar")).alias("s")).select(*KEYS, "s.*")


@query("cigar_stats_noins", _stats_sql("MXmx="))
def _(fx):
    return fx("fx_aln").select(*KEYS, C.cigar_stats(F.col("cigar"), include_ins=False).alias("s")).select(*KEYS, "s.*")


@query("cigar_aln_len", f"select {KEY}, {op_len('cigar')} as aln_len from fx_aln")
def _(fx):
    return fx("fx_aln").select(*KEYS, C.aligned_length(F.col("cigar")).alias("aln_len"))


@query("both_ends_clipped", f"select {KEY}, {both_clipped('cigar')} as clipped from fx_aln")
def _(fx):
    return fx("fx_aln").select(*KEYS, C.both_ends_clipped(F.col("cigar")).alias("clipped"))


@query("clip_in_middle", f"select {KEY}, {mid_clip('cigar', 'pos', 'ref_len')} as middle from fx_aln")
def _(fx):
    return fx("fx_aln").select(*KEYS, C.clip_in_middle(F.col("cigar"), F.col("pos"), F.col("ref_len")).alias("middle"))


@query("cigar_qualified", f"select {KEY}, not bothc and bad <= 2 and aligned >= 45 and not midc as qualified from aln", ALN)
def _(fx):
    return fx("fx_aln").select(*KEYS, C.cigar_qualified(F.col("cigar"), F.col("pos"), F.col("ref_len")).alias("qualified"))


@query("min_dist_to_end", f"select {KEY}, near as dist from aln", ALN)
def _(fx):
    return fx("fx_aln").select(*KEYS, C.min_dist_to_end(F.col("cigar"), F.col("pos"), F.col("ref_len")).alias("dist"))


@query("reverse_complement", "select seq_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as rc from fx_seq")
def _(fx):
    return fx("fx_seq").select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("sam_flag_reverse", "select l_orderkey, l_linenumber, (l_partkey & 16) <> 0 as reversed from lineitem")
def _(fx):
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", S.flag_reverse(F.col("l_partkey")).alias("reversed"))


@query("gc_content", f"select seq_id % 40 as genome, cast(sum(length(seq)) as bigint) as bases, {pct('sum(length(seq) - length(regexp_replace(seq, $$[GCgc]$$, $$$$, $$g$$)))', 'sum(length(seq))')} as gc from fx_seq group by 1".replace("$$", "'"))
def _(fx):
    s = fx("fx_seq").groupBy((F.col("seq_id") % 40).alias("genome"))
    return s.agg(F.sum(F.length("seq")).alias("bases"), C.percent(F.sum(S.gc_count(F.col("seq"))), F.sum(F.length("seq"))).alias("gc"))


@query("contig_ends", """select seq_id, '' as side, seq from fx_seq where length(seq) < 2 * (20 + seq_id % 40)
union all select seq_id, 'l', substr(seq, 1, 20 + seq_id % 40) from fx_seq where length(seq) >= 2 * (20 + seq_id % 40)
union all select seq_id, 'r', substr(seq, length(seq) - (20 + seq_id % 40) + 1) from fx_seq where length(seq) >= 2 * (20 + seq_id % 40)""")
def _(fx):
    return Q.contig_ends(fx("fx_seq"), 20 + F.col("seq_id") % 40)


@query("trim_terminal_feature", """select contig, case when at_left then r + 1 else 1 end as kept_from, case when at_left then ref_len else l end as kept_to
from (select *, row_number() over (partition by contig order by gap, l, r) as k
      from (select *, l - 1 <= 100 as at_left, case when l - 1 <= 100 then l - 1 when ref_len - r - 1 <= 100 then ref_len - r - 1 end as gap
            from fx_features join fx_contigs using (contig) where feature = '16S_rRNA') where gap is not null) where k = 1""")
def _(fx):
    return Q.trim_terminal_feature(fx("fx_contigs"), fx("fx_features").filter("feature = '16S_rRNA'"))


@query("linked_end", """select ref_id, cast(median(pos) as double) as mid, case when median(pos) <= max(ref_len) / 3.0 then 'left' when median(pos) >= max(ref_len) * 2 / 3.0 then 'right' else 'middle' end as linked_end
from fx_aln where side = 'marker' group by ref_id""")
def _(fx):
    return Q.linked_end(fx("fx_aln").filter("side = 'marker'"))


RC = "reverse(translate({}, 'ACGTacgt', 'TGCAtgca'))"


@query("join_sequences", f"select a.seq_id, case when a.seq_id % 3 = 0 then {RC.format('a.seq')} else a.seq end || repeat('N', 50) || case when a.seq_id % 2 = 0 then {RC.format('b.seq')} else b.seq end as joined, length(a.seq) as junction from fx_seq a join fx_seq b on b.seq_id = a.seq_id + 1")
def _(fx):
    s = fx("fx_seq")
    a = s.select("seq_id", F.col("seq").alias("left"), F.when(F.col("seq_id") % 3 == 0, "left").otherwise("right").alias("end_l"), F.when(F.col("seq_id") % 2 == 0, "right").otherwise("left").alias("end_r"))
    pairs = a.join(s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("right")), "seq_id")
    return Q.join_sequences(pairs, "end_l", "end_r").select("seq_id", "joined", "junction")


TAXON = "'d__' || n_regionkey || '; p__' || n_name || ';c__' || c_custkey"


@query("taxon_ranks", f"select c_custkey, list_aggregate(list_transform(string_split({TAXON}, ';'), lambda v: trim(v)), 'string_agg', '|') as ranks from customer join nation on c_nationkey = n_nationkey")
def _(fx):
    t = F.concat(F.lit("d__"), F.col("n_regionkey"), F.lit("; p__"), F.col("n_name"), F.lit(";c__"), F.col("c_custkey"))
    return fx.table("customer").join(fx.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array_join(S.taxon_ranks(t), "|").alias("ranks"))


@query("taxon_confidence_format", "select c_custkey, case when c_custkey % 7 = 0 then 'Unclassified' else 'T' || (c_custkey % 50) || '(' || substr('0.' || (c_custkey * 7919 % 100000), 1, 5) || ')' end as label from customer")
def _(fx):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.lit("Unclassified;1.0")).otherwise(F.concat(F.lit("T"), (F.col("c_custkey") % 50).cast("string"), F.lit(";0."), (F.col("c_custkey") * 7919 % 100000).cast("string")))
    return fx.table("customer").select("c_custkey", S.taxon_with_confidence(raw).alias("label"))


# ---------------------------------------------------------------- filters


@query("filter_seq_length", "select doc_id, length(text) as len from documents where length(text) >= 1200")
def _(fx):
    return fx.table("documents").select("doc_id", F.length("text").cast("long").alias("len")).filter("len >= 1200")


@query("dedupe_marker_ids", "select doc_id, source || case when row_number() over (partition by source order by doc_id) > 1 then '_' || row_number() over (partition by source order by doc_id) else '' end as new_id from documents")
def _(fx):
    return R.dedupe_ids(fx.table("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "new_id")


@query("remove_both_ends_clipped", f"select {KEY} from aln where not bothc", ALN)
def _(fx):
    return P.remove_both_ends_clipped(fx("fx_aln")).select(*KEYS)


@query("remove_high_mismatch", f"select {KEY} from aln where not bothc and bad <= 2 and aligned >= 45 and not midc", ALN)
def _(fx):
    return P.remove_high_mismatch(fx("fx_aln")).select(*KEYS)


@query("keep_best_matches", f"select {KEY} from (select *, min(bad) over (partition by read_base, mate) as least from aln) where bad <= least * 1.5", ALN)
def _(fx):
    return P.keep_best_matches(fx("fx_aln")).select(*KEYS)


@query("keep_best_matches_long", f"select {KEY} from (select *, coalesce(min(bad) filter (where aligned >= 60) over (partition by read_base, mate), min(bad) over (partition by read_base, mate)) as least from aln) where bad <= least * 1.5", ALN)
def _(fx):
    return P.keep_best_matches(fx("fx_aln"), min_aligned=60).select(*KEYS)


@query("both_mates_mapped", f"select {KEY} from fx_aln where read_base in (select read_base from fx_aln group by 1 having count(distinct mate) = 2)")
def _(fx):
    return P.both_mates_mapped(fx("fx_aln")).select(*KEYS)


@query("unmapped_mates", "select read_base, 3 - min(mate) as mate from fx_aln group by 1 having count(distinct mate) = 1")
def _(fx):
    return P.unmapped_mates(fx("fx_aln"))


@query("unique_alignments", f"select {KEY} from fx_aln where (read_base, mate) in (select (read_base, mate) from fx_aln group by read_base, mate having count(distinct ref_id) = 1)")
def _(fx):
    return P.unique_alignments(fx("fx_aln")).select(*KEYS)


@query("insert_size_filter", """select read_base, ref_id, list_max(list_transform(hs, lambda h: h.pos)) - list_min(list_transform(hs, lambda h: case when (h.pos, h.stop) = (m.pos, m.stop) then h.stop end)) as gap
from (select read_base, ref_id, list(h) as hs, min(h) as m from first_hits group by all having count(*) = 2)
where list_max(list_transform(hs, lambda h: h.pos)) - list_min(list_transform(hs, lambda h: case when (h.pos, h.stop) = (m.pos, m.stop) then h.stop end)) >= -1000""",
       f"first_hits as (select read_base, ref_id, mate, min(struct_pack(pos := pos, stop := pos + {op_len('cigar', 'MXmx=')})) as h from fx_aln group by all)")
def _(fx):
    return P.insert_size_filter(fx("fx_aln")).withColumn("gap", F.col("gap").cast("long"))


@query("contig_end_mask", f"""select {KEY} from aln a where side = 'contig'
  and not (pos <= 50 and exists (select 1 from fx_features f where f.contig = a.ref_id and f.l <= 50))
  and not (ref_len - (pos + aligned - 1) <= 50 and exists (select 1 from fx_features f where f.contig = a.ref_id and f.l > 50))""", ALN)
def _(fx):
    mask = fx("fx_features").select("contig", F.when(F.col("l") <= 50, "left").otherwise("right").alias("side"))
    return P.contig_end_mask(fx("fx_aln").filter("side = 'contig'"), mask).select(*KEYS)


REFS = "select distinct marker as ref_id from fx_links where n >= 3"


@query("drop_unlinked_refs", f"select {KEY} from fx_aln where ref_id not in ({REFS})")
def _(fx):
    return P.drop_unlinked_refs(fx("fx_aln"), fx.sql(REFS)).select(*KEYS)


@query("drop_reads_touching_linked", f"select {KEY} from fx_aln where read_base not in (select read_base from fx_aln where ref_id in (select marker from fx_links where n >= 60 union select 'C' || (l_partkey % 400) from lineitem where l_partkey % 400 < 20))")
def _(fx):
    refs = fx.sql("select distinct marker as ref_id from fx_links where n >= 60").union(fx.table("lineitem").select((F.col("l_partkey") % 400).alias("k")).filter("k < 20").select(F.concat(F.lit("C"), F.col("k").cast("string"))).distinct())
    return P.drop_reads_touching(fx("fx_aln"), refs).select(*KEYS)


@query("fetch_reads_by_id", f"select {KEY} from fx_aln where read_base in (select read_base from fx_aln where side = 'marker' and ref_id = 'M7')")
def _(fx):
    a = fx("fx_aln")
    return P.fetch_reads_by_id(a, a.filter("side = 'marker' and ref_id = 'M7'")).select(*KEYS)


@query("split_paired_singleton", f"select {KEY}, count(distinct mate) over (partition by read_base) = 2 as paired from fx_aln".replace("count(distinct mate) over (partition by read_base) = 2", "min(mate) over (partition by read_base) <> max(mate) over (partition by read_base)"))
def _(fx):
    return P.split_paired_singleton(fx("fx_aln")).select(*KEYS, "paired")


@query("pick_one_ref", f"select {KEY} from (select *, row_number() over (partition by read_base, mate order by md5(concat_ws('|', read_base, mate, ref_id, pos, 42)), cigar) as k from fx_aln) where k = 1")
def _(fx):
    return P.pick_one_ref(fx("fx_aln")).select(*KEYS)


BUCKET = "cast(('0x' || substr(md5(concat_ws('|', read_base, 42)), 1, 8)) as bigint) % 10000"


@query("sample_pairs", f"select {KEY} from fx_aln where {BUCKET} < 2500")
def _(fx):
    return P.sample_pairs(fx("fx_aln"), 25).select(*KEYS)


@query("sample_rates", f"select {KEY}, rate from fx_aln, (values (5.0::double), (10.0), (25.0), (50.0)) r(rate) where {BUCKET} < rate * 100")
def _(fx):
    return P.sample_rates(fx("fx_aln"), [5, 10, 25, 50]).select(*KEYS, "rate")


# ---------------------------------------------------------------- sources and sinks


@query("src_fasta", "select 'S' || seq_id as id, 'of ' || (seq_id % 7) as description, seq, length(seq) as len from fx_seq")
def _(fx):
    s = fx("fx_seq").select(F.concat(F.lit("S"), F.col("seq_id").cast("string")).alias("id"), F.concat(F.lit("of "), (F.col("seq_id") % 7).cast("string")).alias("description"), "seq")
    return R.read_fasta(fx.spark, R.stored(s, R.write_fasta, "fasta"))


@query("src_fastq", "select 'S' || seq_id as id, seq, translate(seq, 'ACGTN', '@FI#!') as qual from fx_seq")
def _(fx):
    s = fx("fx_seq").select(F.concat(F.lit("S"), F.col("seq_id").cast("string")).alias("id"), "seq", F.translate("seq", "ACGTN", "@FI#!").alias("qual"))
    return R.read_fastq(fx.spark, R.stored(s, R.write_fastq, "fastq"))


@query("src_sam", "select read_base, mate, ref_id, pos, cigar from fx_aln")
def _(fx):
    return R.read_sam(fx.spark, R.stored(fx("fx_aln"), R.write_sam, "sam")).select("read_base", "mate", "ref_id", "pos", "cigar")


@query("src_sam_refs", "select distinct ref_id, ref_len from fx_aln")
def _(fx):
    return R.read_sam_refs(fx.spark, R.stored(fx("fx_aln"), R.write_sam, "sam"))


@query("src_gff", "select contig, l, r from fx_features where feature = '16S_rRNA'")
def _(fx):
    return R.read_gff(fx.spark, R.stored(fx("fx_features"), R.write_gff, "gff"), "16S_rRNA").select("contig", "l", "r")


@query("src_blast6", "select query, subject, iden, aln_len, bitscore, qlen from fx_hits")
def _(fx):
    return R.read_blast6(fx.spark, R.stored(fx("fx_hits"), R.write_blast6, "blast")).select("query", "subject", "iden", "aln_len", "bitscore", "qlen")


@query("src_uc", "select doc_id % 50 as cluster, 'D' || doc_id as id from documents")
def _(fx):
    d = fx.table("documents").select((F.col("doc_id") % 50).alias("cluster"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"))
    return R.read_uc(fx.spark, R.stored(d, R.write_uc, "uc"))


@query("src_depth", "select ref_id, pos, depth from fx_depth")
def _(fx):
    return R.read_depth(fx.spark, R.stored(fx("fx_depth").select("ref_id", "pos", "depth"), R.write_tsv, "depth"))


@query("src_regions_csv", "select cast(seq_id as string) as seq_id, v, l, r from fx_regions where l is not null")
def _(fx):
    return R.read_regions_csv(fx.spark, R.stored(fx("fx_regions"), R.write_regions_csv, "regions"))


@query("src_links_tsv", "select marker, genome, n, 'Rd' || (n % 2 + 1) as round from fx_links")
def _(fx):
    d = fx("fx_links").select("marker", "genome", "n", F.concat(F.lit("Rd"), (F.col("n") % 2 + 1).cast("string")).alias("round"))
    return R.read_links_tsv(fx.spark, R.stored(d, R.write_links_tsv, "links"))


@query("src_provided_cn", "select genome, cast(1 + count(*) % 5 as double) as n from fx_contigs group by genome")
def _(fx):
    d = fx("fx_contigs").groupBy("genome").agg((1 + F.count("*") % 5).cast("double").alias("n"))
    return R.read_provided_cn(fx.spark, R.stored(d, R.write_tsv, "cn"))


@query("src_genome_dir", "select 'G' || (seq_id % 5) as genome, 'G' || (seq_id % 5) || '___C___S' || seq_id as contig, length(seq) as len from fx_seq")
def _(fx):
    s = fx("fx_seq").select(F.concat(F.lit("G"), (F.col("seq_id") % 5).cast("string")).alias("genome"), F.concat(F.lit("S"), F.col("seq_id").cast("string")).alias("id"), "seq")
    return R.read_genome_dir(fx.spark, R.stored(s, R.write_genome_dir, "genomes")).select("genome", "contig", "len")


@query("rename_reads", "select doc_id, 'R_' || row_number() over (order by doc_id) as new_id from documents")
def _(fx):
    return R.number_rows(fx.table("documents").select("doc_id"), ["doc_id"], "k").select("doc_id", F.concat(F.lit("R_"), F.col("k").cast("string")).alias("new_id"))


@query("interleave_pairs", "select read_base, mate, dense_rank() over (order by read_base) * 2 - 2 + mate as place from (select distinct read_base, mate from fx_aln)")
def _(fx):
    a = fx("fx_aln").select("read_base", "mate").distinct()
    bases = R.number_rows(a.select("read_base").distinct(), ["read_base"], "k")
    return a.join(bases, "read_base").select("read_base", "mate", (F.col("k") * 2 - 2 + F.col("mate")).alias("place"))




CLIPS = r"clips as (select *, coalesce(try_cast(regexp_extract(cigar, '^(\d+)[Ss]', 1) as int), 0) as lc, coalesce(try_cast(regexp_extract(cigar, '(\d+)[Ss]$', 1) as int), 0) as rc from fx_aln)"


@query("max_clip", "select read_base, n as clip_len, case when n > 0 then 'r' || mate || '_' || side else '' end as clip_end, case when n > 0 then cigar else '' end as cigar from (select *, row_number() over (partition by read_base order by n desc, mate, cigar, side) as k from (select read_base, mate, cigar, 'l' as side, lc as n from clips union all select read_base, mate, cigar, 'r', rc from clips)) where k = 1", CLIPS)
def _(fx):
    return P.max_clip(fx("fx_aln"))


@query("min_max_clip", "select read_base, min(n) as min_clip, max(n) as max_clip from (select read_base, unnest(case when lc = 0 and rc = 0 then [0] when lc = 0 then [rc] when rc = 0 then [lc] else [lc, rc] end) as n from clips) group by 1", CLIPS)
def _(fx):
    return P.min_max_clip(fx("fx_aln"))


@query("sink_fasta", "select '>S' || seq_id as head, seq from fx_seq")
def _(fx):
    s = fx("fx_seq").select(F.concat(F.lit("S"), F.col("seq_id").cast("string")).alias("id"), "seq")
    back = fx.spark.read.option("lineSep", "\n>").text(R.stored(s, R.write_fasta, "fasta")).select(F.split(F.regexp_replace("value", r"^>|\s+$", ""), "\n").alias("v"))
    return back.select(F.concat(F.lit(">"), F.col("v")[0]).alias("head"), F.col("v")[1].alias("seq"))


@query("sink_sam", "select read_base || '.' || mate as id, '0' as flag, ref_id as ref, cast(pos as varchar) as pos, cigar from fx_aln union all select '@SQ', 'SN:' || ref_id, 'LN:' || ref_len, null, null from (select distinct ref_id, ref_len from fx_aln)")
def _(fx):
    c = F.split("value", "\t")
    return fx.spark.read.text(R.stored(fx("fx_aln"), R.write_sam, "sam")).select(*(F.try_element_at(c, F.lit(i)).alias(n) for i, n in ((1, "id"), (2, "flag"), (3, "ref"), (4, "pos"), (6, "cigar"))))
