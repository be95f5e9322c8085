"""Alignment-shaped inputs derived from the driver's tables, as SQL that Spark and DuckDB both run.

Every view takes whole tables, and its keys grow with them: 200 parts (and the 1,500 orders that go with them) are a family
of 12 markers, 40 contigs and 4 genomes.  `each(n)` is a row for each of 1 to n."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

VIEWS = {
    "fx_contigs": """select concat('C', cast(k as string)) as contig, concat('G', cast(f * 4 + k % 4 as string)) as genome, cast(600 + (k % 7) * 250 as int) as ref_len
from (select distinct cast(floor(p_partkey / 200.0) as int) as f, cast(floor(p_partkey / 200.0) as int) * 40 + cast(p_partkey % 40 as int) as k from part) t""",
    "fx_markers": """select concat('M', cast(k as string)) as marker, cast(1200 + (k % 5) * 80 as int) as ref_len
from (select distinct cast(floor(p_partkey / 200.0) as int) * 12 + cast(p_partkey % 12 as int) as k from part) t""",
    "fx_aln_raw": """select l_orderkey as read_base, cast(l_linenumber % 2 + 1 as int) as mate,
  case when l_linenumber % 4 < 2 then 'marker' else 'contig' end as side,
  cast(l_partkey % 300 as int) as mk, cast(l_partkey % 720 as int) as ck,
  cast(floor(l_quantity) as int) as q, cast(floor(l_discount * 100 + 0.5) as int) as d,
  cast(floor(l_tax * 100 + 0.5) as int) as tx, cast((l_partkey * 7 + l_suppkey) % 500 as int) as h,
  cast(l_linenumber as int) as ln, cast(floor(l_orderkey / 1500.0) as int) as f
from lineitem""",
    # within a family low numbers are rarer; one row in nine goes to any of the family
    "fx_aln_fam": """select read_base, mate, side, q, d, tx, h, ln, f,
  case when side = 'marker' then f * 12 + (case when h % 9 = 0 then mk % 12 else cast(floor(sqrt(cast(mk % 25 as double))) as int) end)
       else f * 40 + (case when h % 9 = 0 then ck % 40 else cast(floor(sqrt(cast(ck % 36 as double))) as int) end) end as rk
from fx_aln_raw""",
    "fx_aln_pos": """select a.read_base, a.mate, a.side, a.q, a.d, a.tx, a.h, a.ln, a.f,
  case when side = 'marker' then concat('M', cast(rk as string)) else concat('C', cast(rk as string)) end as ref_id,
  cast(case when side = 'marker' then 1200 + (rk % 5) * 80 else 600 + (rk % 7) * 250 end as int) as ref_len,
  45 + q as m, case when d >= 10 then 2 when d >= 7 then 1 else 0 end as x, (h + ln) % 8 as kind
from fx_aln_fam a""",
    "fx_aln": """select read_base, mate, side, ref_id, ref_len,
  case when kind in (0, 1, 2, 4) then 1 + (case when kind = 4 then 0 else h end)
       when kind = 5 then ref_len - m + 1 else 5 + h end as pos,
  concat(case when kind in (4, 6, 7) then concat(cast(20 + tx as string), 'S') else '' end,
         case when x > 0 then concat(cast(m - 10 - x as string), '=', cast(x as string), 'X10=') else concat(cast(m as string), '=') end,
         case when kind in (5, 7) then concat(cast(20 + tx as string), 'S') else '' end) as cigar
from fx_aln_pos""",
    # alignments of the same reads to assembled bridges, three for each genome of the family
    "fx_minis": """select read_base, mate, concat('X', cast(k as string)) as ref_id, cast(400 + (k % 5) * 60 as int) as ref_len,
  case when kind in (4, 7) then 1 else 1 + h % 200 end as pos,
  concat(case when kind = 4 then concat(cast(20 + tx as string), 'S') else '' end, cast(m as string), '=') as cigar
from (select read_base, mate, tx, h, m, kind, f * 12 + cast(floor(sqrt(cast(q * 3 % 144 as double))) as int) as k from fx_aln_pos) t""",
    "fx_ident": """select least(concat('M', cast(a as string)), concat('M', cast(b as string))) as a,
  greatest(concat('M', cast(a as string)), concat('M', cast(b as string))) as b,
  cast(95 + (a * 7 + b * 3) % 6 as double) as iden
from (select p.k as a, r.k as b
      from (select distinct cast(floor(p_partkey / 200.0) as int) as f, cast(floor(p_partkey / 200.0) as int) * 12 + cast(p_partkey % 12 as int) as k from part) p
      join (select distinct cast(floor(p_partkey / 200.0) as int) as f, cast(floor(p_partkey / 200.0) as int) * 12 + cast(p_partkey % 12 as int) as k from part) r on p.f = r.f and p.k < r.k) t""",
    "fx_depth": """select ref_id, cast(pos as int) as pos, cast((k * 13 + pos * 7 + (pos % 11) * 5) % 60 as int) as depth
from (select concat('C', cast(p_partkey as string)) as ref_id, p_partkey as k, each(60 + cast(p_partkey % 7 as int) * 25) as pos from part) t""",
    # families of four sequences: three share most of their bases, the fourth has only a piece in common
    "fx_seq": """select seq_id, translate(case when seq_id % 4 = 0 then base when seq_id % 4 = 1 then concat(substr(base, 1, 40), 'a', substr(base, 42)) when seq_id % 4 = 2 then concat(substr(base, 1, 88), substr(own, 1, 8))
       else concat(substr(base, 1, 32), own, md5(own)) end, '0123456789abcdef', 'ACGTACGTACGTACGN') as seq
from (select doc_id as seq_id, concat(md5(concat(cast(floor(doc_id / 4.0) as int), 'a')), md5(concat(cast(floor(doc_id / 4.0) as int), 'b')), md5(concat(cast(floor(doc_id / 4.0) as int), 'c'))) as base,
        md5(concat(cast(doc_id as string), 'own')) as own from documents) t""",
    # the same, one sequence in eight read from the other strand
    "fx_strands": """select seq_id, case when seq_id % 8 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from fx_seq""",
    # seven-column BLAST-like hits between query and subject sequences
    "fx_hits": """select concat('Q', cast(cast(floor(l_orderkey / 50.0) as int) as string)) as query, concat('R', cast(l_partkey % 40 as string)) as subject,
  cast(95 + (l_partkey % 51) * 0.1 as double) as iden, cast(100 + (l_suppkey * 37 + l_orderkey) % 2000 as int) as aln_len,
  cast(floor(l_extendedprice) as double) as bitscore, cast(1200 + (l_orderkey % 5) * 80 as int) as qlen, cast(l_orderkey * 10 + l_linenumber as bigint) as ord
from lineitem""",
    # features (closed intervals) on contigs, one in five near the right end
    "fx_features": """select contig, case when near_end then ref_len - 20 - size - h % 120 else 1 + (h * 17) % 300 end as l, (case when near_end then ref_len - 20 - size - h % 120 else 1 + (h * 17) % 300 end) + size as r,
  case when h % 3 = 0 then '16S_rRNA' else 'other' end as feature
from (select concat('C', cast(k as string)) as contig, cast(600 + (k % 7) * 250 as int) as ref_len, h, size, near_end
      from (select cast(floor(p_partkey / 200.0) as int) * 40 + cast(p_partkey % 40 as int) as k, cast(p_partkey * 13 % 1009 as int) as h, cast(20 + p_size as int) as size, p_partkey % 5 = 1 as near_end from part) t) u""",
    # link table: marker, genome, reads.  The last two markers of a family have none
    "fx_links": """select concat('M', cast(cast(floor(l_partkey / 200.0) as int) * 12 + cast(floor(sqrt(cast(l_partkey % 100 as double))) as int) as string)) as marker,
  concat('G', cast(cast(floor(l_partkey / 200.0) as int) * 4 + cast(floor(sqrt(cast(l_suppkey % 16 as double))) as int) as string)) as genome, cast(count(*) as bigint) as n
from lineitem group by 1, 2""",
    # nine variable regions of a sequence (null: not found)
    "fx_regions": """select seq_id, v, ref_len, case when (seq_id * 3 + v * 5) % 11 = 0 then null else cast(v * 150 - 100 + seq_id % 20 as int) end as l,
  case when (seq_id * 3 + v * 5) % 11 = 0 then null else cast(v * 150 - 40 + seq_id % 25 as int) end as r
from (select p_partkey as seq_id, 1400 + cast(p_partkey % 5 as int) * 20 as ref_len, each(9) as v from part) t""",
}


def _needed(text: str) -> list[str]:
    seen: list[str] = []

    def visit(sql: str) -> None:
        for name, own in VIEWS.items():
            if name not in seen and re.search(rf"\b{name}\b", sql):
                visit(own)
                if name not in seen:
                    seen.append(name)

    visit(text)
    return seen


def with_fixtures(sql: str, ctes: str = "") -> str:
    parts = [f"{n} as ({VIEWS[n]})" for n in _needed(f"{ctes} {sql}")] + ([ctes] if ctes.strip() else [])
    return (f"with {', '.join(parts)} " if parts else "") + sql


def _each(sql: str, new: str) -> str:
    """each(n) in the words of an engine; n may hold brackets."""
    while (at := sql.find("each(")) >= 0:
        end, deep = at + 5, 1
        while deep:
            deep += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + new.format(sql[at + 5 : end - 1]) + sql[end:]
    return sql


def in_spark(sql: str) -> str:
    return _each(sql, "explode(sequence(1, {}))")


def in_duckdb(sql: str) -> str:
    return _each(sql, "unnest(range(1, {} + 1))")


class Inputs:
    """Tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over tables, fixture views and the given frames."""
        names = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", with_fixtures(text))} | frames
        body = with_fixtures(text)
        for n in names:
            body = re.sub(rf"(?i)\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", body)
        return self.spark.sql(in_spark(body), **names)

    def __call__(self, view: str) -> DataFrame:
        return self.sql(f"select * from {view}")
